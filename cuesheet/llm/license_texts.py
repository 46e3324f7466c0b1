"""Known licence texts and notices. Fixed values, as published; several forms of one licence have the ids X, X#2, ..."""

_MIT_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_PERMISSION = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ZERO_PERMISSION = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GPL3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

KNOWN = {
    "MIT": _MIT_PERMISSION,
    "MIT#2": "MIT License\n\n" + _MIT_PERMISSION,
    "MIT#3": "The MIT License (MIT)\n\n" + _MIT_PERMISSION,
    "MIT#4": "Released under the MIT License.",
    "MIT#5": "Licensed under the MIT License.",
    "MIT#6": "SPDX-License-Identifier: MIT",
    "ISC": _ISC_PERMISSION + "\n\n" + _ISC_DISCLAIMER,
    "ISC#2": "ISC License\n\n" + _ISC_PERMISSION + "\n\n" + _ISC_DISCLAIMER,
    "0BSD": _ZERO_PERMISSION + "\n\n" + _ISC_DISCLAIMER,
    "BSD-2-Clause": _BSD_START + "\n\n" + _BSD_DISCLAIMER,
    "BSD-2-Clause#2": "BSD 2-Clause License\n\n" + _BSD_START + "\n\n" + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_START + "\n\n" + _BSD_THIRD + "\n\n" + _BSD_DISCLAIMER,
    "BSD-3-Clause#2": "BSD 3-Clause License\n\n" + _BSD_START + "\n\n" + _BSD_THIRD + "\n\n" + _BSD_DISCLAIMER,
    "BSD-3-Clause#3": "SPDX-License-Identifier: BSD-3-Clause",
    "Zlib": _ZLIB,
    "Unlicense": _UNLICENSE,
    "Apache-2.0": _APACHE_HEADER,
    "Apache-2.0#2": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#3": "SPDX-License-Identifier: Apache-2.0",
    "GPL-3.0": _GPL3_HEADER,
    "GPL-3.0#2": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#3": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0#4": "SPDX-License-Identifier: GPL-3.0-only",
    "MPL-2.0": _MPL_HEADER,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0#2": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0#2": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0#2": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

#: Digests of the canonical forms of whole published texts.
DIGESTS = {
    "Apache-2.0": "323470f90b09495a69f0c40a7f31a6679d0a151830f653f5115e25e7f06e4631",
    "Artistic-1.0-Perl": "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    "CC0-1.0": "e5d51a5ae235adee59a9ad1ae1122f080c0b4573529b78b5f5263702a9d6835c",
    "GFDL-1.2": "2ac141fb5af3b1d9af299fdcde7bcc13a1c1370c360218eda71411f7e2a881ea",
    "GFDL-1.3": "527988e8cd438f5f5bdf2b430126287ce638ef41cb9cae52a0cf1430742d4cf1",
    "GPL-1.0": "a48193c59d5c82f5a3ba1c79919d808a144787c3ffa743b4ff81998ffaa76e39",
    "GPL-2.0": "c1cc0e90f7cf40ad93784a985ee5d784e30cbaf3aa417577263df37e61d7786a",
    "GPL-3.0": "fef5e9003dc27196ec8e341d7739e00992e3e936d44ce92b866a8af8850a20a7",
    "LGPL-2.0": "d061885f75092f5cf0eab2ecab75c4fefee7fab4d77181e37a31c8d1637749e9",
    "LGPL-2.1": "0c7a900d80c6c5db4509200e1b6bc60bc2f9fc708ffdbd7fd8c00893ff6e8f2c",
    "LGPL-3.0": "66b14fc34f93c936630900c706c308c8ebf4fca8e604f1c91574d68a7c96cc53",
    "MPL-1.1": "357148256b1935b113d22eee3c26fec0e452c767700262943ca9b84680771652",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
