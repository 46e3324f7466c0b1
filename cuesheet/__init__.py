"""A PySpark engine for timeline catalogues: titles, videos and time offsets from free-text comments."""
