"""Word lists, marks and patterns that decide what a timeline line is. Stated as they have to be."""

# Words and phrases that, anywhere in a title, make it no song.
NON_SONG_PARTS = (
    "mc", "talk", "chat", "free talk", "zatsu", "opening", "ending", "start", "end", "break", "superchat", "reading",
    "comment", "encore", "announcement", "notice", "雑談", "挨拶", "開始", "配信開始", "配信", "配信予定", "ゲーム配信", "予定",
    "報告", "突破", "達成", "睡眠", "周年", "スケジュール", "運転", "グッズ", "発送", "特典", "ボイス", "メン限", "asmr", "fanbox",
    "プラン", "変更", "旅行", "終了", "終わり", "おつ", "告知", "宣伝", "お知らせ", "休憩", "スパチャ", "スーパーチャット", "朗読",
    "読み", "感想", "振り返り", "お名前呼び", "名前呼び", "待機", "準備", "音量", "マイク", "コメント", "遅刻", "エンディング", "登場",
    "誕生日", "おめでとう", "プレゼント", "誕生秘話", "秘話", "話題", "こんしゃいる", "しゃるお", "しゃるめいと", "圧しゃいる",
    "干し芋", "校舎裏", "夕飯", "ポムの樹", "フルボッコタイム",
)
# Whole titles, without spaces, that are no song.
NON_SONG_WHOLE = ("op", "ed", "start", "end", "mc", "talk", "aパート", "bパート", "cパート")
NON_SONG_STARTS = ("op:", "ed:", "mc:")
# Parts that make the only entry of a song doubtful.
DOUBTFUL_PARTS = (
    "fanbox", "twitter", "x ", "youtube", "twitch", "discord", "booth", "goods", "asmr", "apex", "bgm", "case", "配信", "予定",
    "告知", "お知らせ", "報告", "突破", "達成", "周年", "グッズ", "プラン", "変更", "旅行", "運転", "発送", "特典", "ボイス",
    "スケジュール", "明日", "今日", "昨日", "明後日", "背景", "chカウンター", "cパート",
)
QUOTES = (('"', '"'), ("'", "'"), ("「", "」"), ("『", "』"), ("“", "”"))
STREAM_PARTS = ("歌枠", "karaoke", "singing", "sing", "カラオケ", "弾き語り", "歌ってみた", "setlist")
KNOWN_ARTISTS = (
    "ado", "aimyon", "aimer", "kanaria", "kemu", "lisa", "minato", "n-buna", "nbuna", "orangestar", "supercell", "yoasobi",
    "yonezukenshi", "星街すいせい", "米津玄師", "初音ミク",
)
ENCORES = ("encore", "アンコール")

# Marks between title and artist.
DECORATION = r"\-*:|/\\~>#‐-―：｜／"
KANA_TO_HAN = "぀-ヿ㐀-鿿"
LETTER_OR_CJK = r"[\p{L}぀-ヿ㐀-䶿一-鿿가-힯]"
MARKER = r"タイム{s}*スタンプ|time{s}*stamps?|セット{s}*リスト|set{s}*lists?|セトリ|曲{s}*リスト|songs?{s}*lists?"
ARTIST_SPLIT = (
    r"{s}*(?:×|[&＆]|・|＋|\+|{s}+[xX]{s}+|\bw{s}*[/／]{s}*|\bfeat\.?\b|\bft\.?\b|\bwith\b|\band\b"
    r"|\bcovered{s}+by\b|\bcover{s}+by\b|[/／]){s}*"
)
NUMBERED = r"\[{s}*{d}+{s}*\]|\({s}*{d}+{s}*\)|（{s}*{d}+{s}*）|{d}+[.)、]|{d}{{1,3}}{s}+|{d}{{1,3}}曲目{s}*"
SEPARATOR = r"{s}(?:-|/|\||–|—|／|｜){s}|[/／]"
VERSION_KINDS = r"(?:piano|acoustic|guitar|live|karaoke|instrumental|remix|arrange|off{s}*vocal)"
VERSION_TAIL = (
    r"{s}*(?:-|–|—|\(|（|\[|［)?{s}*(?:(?:[a-z0-9' ]+{s}+)?" + VERSION_KINDS + r"{s}*(?:ver\.?|version)?|" + VERSION_KINDS
    + r"{s}*(?:ver\.?|version)?|ver\.?|version|ピアノ(?:ver\.?)?|アコースティック(?:ver\.?)?|ギター(?:ver\.?)?|アレンジ(?:ver\.?)?){s}*(?:\)|）|\]|］)?{s}*"
)
VERSION_WORDS = ("acoustic", r"ver\.?", "version", "arrange", "remix", "the{s}+first{s}+take", "from", "live", "instrumental", "off{s}*vocal", "piano", "guitar", "karaoke")
VERSION_KANA = ("アコースティック", "バージョン", "ピアノ", "ギター", "アレンジ")
CHANNEL_PAGE = (r'"browseId":"(UC[^"]+)"', r'"channelId":"(UC[^"]+)"', r'"externalId":"(UC[^"]+)"', r'<meta itemprop="channelId" content="(UC[^"]+)"')
