"""Limits and fixed sets. Results depend on them being exactly these."""

# Bodies strictly larger than this are rejected (100 MiB).
SIZE_LIMIT_BYTES = 104_857_600
# Content strictly larger than this (UTF-8 bytes) is split instead of returned inline.
INLINE_LIMIT_BYTES = 51_200
# Sections strictly shorter than this (characters) merge into their neighbour.
MIN_SECTION_CHARS = 1_000
# A CSV with at most this many rows, header included, stays inline.
CSV_INLINE_ROWS = 101
# Data rows per CSV chunk.
CSV_GROUP_ROWS = 100
# Chunk keys are cut to this many characters.
KEY_CHARS = 60
# A heading line has between these many characters after trimming.
HEADING_MIN_CHARS = 2
HEADING_MAX_CHARS = 120
# Records strictly older than this are stale, or deleted.
STALE_AFTER_DAYS = 1
DELETE_AFTER_DAYS = 30

# Fixed values. Extensions of archive members that hold readable text.
ARCHIVE_TEXT_EXTENSIONS = [
    "txt", "md", "json", "xml", "csv", "yml", "yaml", "toml", "ini", "cfg", "conf", "log", "sh", "bat", "ps1",
    "py", "js", "ts", "tsx", "jsx", "css", "html", "htm", "svg", "lua", "rb", "go", "rs", "java", "c", "cpp", "h",
    "hpp", "sql", "r", "m", "swift",
]

# Fixed values, down to the text audit. Header substring -> kind, first match wins.
HEADER_KINDS = [
    ("text/html", "html"),
    ("application/pdf", "pdf"),
    ("application/json", "json"),
    ("text/csv", "csv"),
    ("application/zip", "zip"),
    ("application/gzip", "zip"),
    ("application/x-tar", "zip"),
]
# URL extension -> kind when the header says application/octet-stream.
OCTET_STREAM_EXTENSION_KINDS = {
    "pdf": "pdf", "zip": "zip", "tar": "zip", "gz": "zip", "tgz": "zip", "csv": "csv",
}
# URL extension -> kind when the header is missing or says nothing useful.
EXTENSION_KINDS = {
    "pdf": "pdf", "json": "json", "csv": "csv",
    "zip": "zip", "tar": "zip", "gz": "zip", "tgz": "zip",
    "html": "html", "htm": "html",
}
# Header substrings that mark a body of unknown kind as binary.
BINARY_HEADERS = ["application/pdf", "application/octet-stream", "image/", "audio/", "video/"]

# Fixed values. Text audit: names and extensions that are never scanned, and the extensions scanned at the top level.
AUDIT_SKIP_NAMES = ["node_modules", ".git", "dist", "data.sqlite"]
AUDIT_SKIP_EXTENSIONS = [".db", ".sqlite"]
AUDIT_SCAN_DIRS = ["src", "docs", "tools"]
AUDIT_ROOT_EXTENSIONS = [".md", ".json"]

# White space as trimmed from text: ASCII controls, Unicode space separators, line separators, BOM.
SPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
# The same set inside a regular expression character class.
SPACE_CLASS = r"\x09-\x0D \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
