"""Fixed values and the character tables derived from them."""

from __future__ import annotations

import unicodedata
from functools import cache

# What counts as a missing amount.
AMOUNT_MISSING = (
    "", "-", "—", "–", "－",
    "N/A", "n/a", "NA", "na",
    "None", "none", "null", "Null", "NULL",
    "nan", "NaN", "NAN",
)

# What the delimited reader takes as missing (the public pandas defaults).
TEXT_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Marks dropped from an amount, and the minus sign that becomes "-".
CURRENCY = "¥￥$"
THOUSANDS = ",，"
ZERO_WIDTH = "​﻿"
UNICODE_MINUS = "−"

# Separator keywords, the default join separator, the detection order
# and the marks that make a one-column result suspect.
WHITESPACE_WORDS = ("space", "空格", "whitespace", "空白")
TAB_WORDS = ("\\t", "tab", "制表", "制表符")
JOIN_SEPARATOR = "；"
DETECTION_ORDER = ("\t", "|", ",", ";", "whitespace")
SUSPECT_MARKS = "[\t|,;]|  "
DETECTION_SAMPLE = 50

# Extension -> category, first category wins.
CATEGORIES = {
    "办公文档": (
        ".doc", ".docx", ".xls", ".xlsx", ".xlsm", ".csv",
        ".ppt", ".pptx", ".pdf", ".odt", ".ods", ".odp", ".rtf", ".txt",
    ),
    "图片": (
        ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff",
        ".webp", ".svg", ".heic", ".ico", ".raw",
    ),
    "音频": (
        ".mp3", ".wav", ".m4a", ".flac", ".aac", ".ogg", ".wma", ".aiff",
    ),
    "视频": (
        ".mp4", ".mkv", ".mov", ".avi", ".wmv", ".flv", ".mpeg", ".3gp", ".webm",
    ),
    "压缩包": (
        ".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz", ".iso",
    ),
    "财务账套": (
        ".udb", ".vdb", ".vdd", ".ais", ".tplus", ".bdf", ".pbd",
        ".ini", ".bak", ".bkp", ".aiy", ".air", ".ldb", ".gdb",
    ),
    "数据库": (
        ".db", ".db3", ".mdb", ".accdb", ".sqlite", ".sqlite3",
        ".sql", ".dbf", ".dbx", ".dbs", ".mdf", ".ndf", ".ldf",
        ".frm", ".ibd", ".myd", ".myi", ".par", ".dmp", ".ora",
        ".dat", ".fdb", ".gdb", ".sdf", ".kdb", ".ais", ".tplus",
    ),
    "可执行文件": (
        ".exe", ".msi", ".bat", ".sh", ".app", ".apk", ".com",
    ),
    "代码文件": (
        ".py", ".js", ".html", ".css", ".cpp", ".c", ".java", ".cs",
        ".php", ".rb", ".ts", ".json", ".xml", ".yml",
    ),
}
OTHER_CATEGORY = "其他"

# Rows per output part with and without folder links, title width.
PART_ROWS_LINKED = 32765
PART_ROWS = 65530
TITLE_WIDTH = 31

# Output column names.
ROWS_COLUMN = "被聚合行数"
INVENTORY_COLUMNS = (
    ("folder", "文件夹路径"),
    ("name", "文件名"),
    ("ext", "扩展名"),
    ("created", "创建日期"),
    ("modified", "修改日期"),
    ("size_mb", "文件大小(MB)"),
    ("detected", "检测类型"),
    ("path", "文件链接"),
    ("category", "分类"),
)
SUMMARY_COLUMNS = ("分类", "文件数", "总大小(MB)")
TOTAL_LABEL = "总计"
AUDIT_COLUMNS = ("时间", "操作", "文件路径", "备注")
SCAN_OK = "扫描完成"
SCAN_FAILED = "扫描失败"
SAVED_TABLES = "保存工作簿"
SAVED_CSV = "保存CSV"

# File signatures as (mime, extension, ((offset, bytes), ...)), first
# match wins. The names are those of public MIME registries.
SIGNATURES = (
    ("image/vnd.dwg", "dwg", ((0, b"AC10"),)),
    ("image/x-xcf", "xcf", ((0, b"gimp xcf v"),)),
    ("image/jpeg", "jpg", ((0, b"\xff\xd8\xff"),)),
    ("image/jpx", "jpx", ((0, b"\x00\x00\x00\x0cjP  \r\n\x87\n"),)),
    ("image/png", "png", ((0, b"\x89PNG"),)),
    ("image/gif", "gif", ((0, b"GIF"),)),
    ("image/webp", "webp", ((0, b"RIFF"), (8, b"WEBP"))),
    ("image/x-canon-cr2", "cr2", ((0, b"II*\x00"), (8, b"CR"))),
    ("image/tiff", "tif", ((0, b"II*\x00"),)),
    ("image/tiff", "tif", ((0, b"MM\x00*"),)),
    ("image/bmp", "bmp", ((0, b"BM"),)),
    ("image/vnd.ms-photo", "jxr", ((0, b"II\xbc"),)),
    ("image/vnd.adobe.photoshop", "psd", ((0, b"8BPS"),)),
    ("image/x-icon", "ico", ((0, b"\x00\x00\x01\x00"),)),
    ("image/heic", "heic", ((4, b"ftypheic"),)),
    ("image/avif", "avif", ((4, b"ftypavif"),)),
    ("image/qoi", "qoi", ((0, b"qoif"),)),
    ("image/dds", "dds", ((0, b"DDS "),)),
    ("video/3gpp", "3gp", ((4, b"ftyp3gp"),)),
    ("video/x-m4v", "m4v", ((4, b"ftypM4V"),)),
    ("audio/mp4", "m4a", ((4, b"ftypM4A"),)),
    ("video/quicktime", "mov", ((4, b"ftypqt  "),)),
    ("video/mp4", "mp4", ((4, b"ftypisom"),)),
    ("video/mp4", "mp4", ((4, b"ftypiso2"),)),
    ("video/mp4", "mp4", ((4, b"ftypmp41"),)),
    ("video/mp4", "mp4", ((4, b"ftypmp42"),)),
    ("video/mp4", "mp4", ((4, b"ftypavc1"),)),
    ("video/x-msvideo", "avi", ((0, b"RIFF"), (8, b"AVI"))),
    ("video/x-ms-wmv", "wmv", ((0, b"0&\xb2u\x8ef\xcf\x11\xa6\xd9"),)),
    ("video/mpeg", "mpg", ((0, b"\x00\x00\x01\xba"),)),
    ("video/mpeg", "mpg", ((0, b"\x00\x00\x01\xb3"),)),
    ("video/x-flv", "flv", ((0, b"FLV\x01"),)),
    ("audio/aac", "aac", ((0, b"\xff\xf1"),)),
    ("audio/aac", "aac", ((0, b"\xff\xf9"),)),
    ("audio/midi", "mid", ((0, b"MThd"),)),
    ("audio/mpeg", "mp3", ((0, b"ID3"),)),
    ("audio/mpeg", "mp3", ((0, b"\xff\xfb"),)),
    ("audio/ogg", "ogg", ((0, b"OggS"),)),
    ("audio/x-flac", "flac", ((0, b"fLaC"),)),
    ("audio/x-wav", "wav", ((0, b"RIFF"), (8, b"WAVE"))),
    ("audio/amr", "amr", ((0, b"#!AMR\n"),)),
    ("audio/x-aiff", "aiff", ((0, b"FORM"), (8, b"AIFF"))),
    ("application/font-woff", "woff", ((0, b"wOFF\x00\x01\x00\x00"),)),
    ("application/font-woff", "woff2", ((0, b"wOF2\x00\x01\x00\x00"),)),
    ("application/font-sfnt", "ttf", ((0, b"\x00\x01\x00\x00\x00"),)),
    ("application/font-sfnt", "otf", ((0, b"OTTO\x00"),)),
    ("application/vnd.oasis.opendocument.text", "odt",
     ((0, b"PK\x03\x04"), (30, b"mimetypeapplication/vnd.oasis.opendocument.text"))),
    ("application/vnd.oasis.opendocument.spreadsheet", "ods",
     ((0, b"PK\x03\x04"), (30, b"mimetypeapplication/vnd.oasis.opendocument.spreadsheet"))),
    ("application/vnd.oasis.opendocument.presentation", "odp",
     ((0, b"PK\x03\x04"), (30, b"mimetypeapplication/vnd.oasis.opendocument.presentation"))),
    ("application/epub+zip", "epub", ((0, b"PK\x03\x04"), (30, b"mimetypeapplication/epub+zip"))),
    ("application/msword", "doc",
     ((0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), (512, b"\xec\xa5\xc1\x00"))),
    ("application/vnd.ms-excel", "xls",
     ((0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), (512, b"\x09\x08\x10\x00\x00\x06\x05\x00"))),
    ("application/vnd.ms-powerpoint", "ppt",
     ((0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), (512, b"\xa0\x46\x1d\xf0"))),
    ("application/x-rpm", "rpm", ((0, b"\xed\xab\xee\xdb"),)),
    ("application/zip", "zip", ((0, b"PK\x03\x04"),)),
    ("application/zip", "zip", ((0, b"PK\x05\x06"),)),
    ("application/zip", "zip", ((0, b"PK\x07\x08"),)),
    ("application/x-tar", "tar", ((257, b"ustar"),)),
    ("application/x-rar-compressed", "rar", ((0, b"Rar!\x1a\x07\x00"),)),
    ("application/x-rar-compressed", "rar", ((0, b"Rar!\x1a\x07\x01"),)),
    ("application/gzip", "gz", ((0, b"\x1f\x8b\x08"),)),
    ("application/x-bzip2", "bz2", ((0, b"BZh"),)),
    ("application/x-7z-compressed", "7z", ((0, b"7z\xbc\xaf\x27\x1c"),)),
    ("application/pdf", "pdf", ((0, b"%PDF"),)),
    ("application/x-msdownload", "exe", ((0, b"MZ"),)),
    ("application/x-shockwave-flash", "swf", ((0, b"FWS"),)),
    ("application/x-shockwave-flash", "swf", ((0, b"CWS"),)),
    ("application/rtf", "rtf", ((0, b"{\\rtf"),)),
    ("application/x-nintendo-nes-rom", "nes", ((0, b"NES\x1a"),)),
    ("application/x-google-chrome-extension", "crx", ((0, b"Cr24"),)),
    ("application/vnd.ms-cab-compressed", "cab", ((0, b"MSCF"),)),
    ("application/vnd.ms-cab-compressed", "cab", ((0, b"ISc("),)),
    ("application/postscript", "ps", ((0, b"%!"),)),
    ("application/x-xz", "xz", ((0, b"\xfd7zXZ\x00"),)),
    ("application/x-sqlite3", "sqlite", ((0, b"SQLi"),)),
    ("application/x-deb", "deb", ((0, b"!<arch>\ndebian-binary"),)),
    ("application/x-unix-archive", "ar", ((0, b"!<arch>"),)),
    ("application/x-compress", "Z", ((0, b"\x1f\xa0"),)),
    ("application/x-compress", "Z", ((0, b"\x1f\x9d"),)),
    ("application/x-lzop", "lzo", ((0, b"\x89LZO\x00\r\n\x1a\n"),)),
    ("application/x-lzip", "lz", ((0, b"LZIP"),)),
    ("application/zstd", "zst", ((0, b"\x28\xb5\x2f\xfd"),)),
    ("application/x-lz4", "lz4", ((0, b"\x04\x22\x4d\x18"),)),
    ("application/wasm", "wasm", ((0, b"\x00asm\x01\x00\x00\x00"),)),
    ("application/vnd.apache.parquet", "parquet", ((0, b"PAR1"),)),
)
# Zip packages told apart by a folder name in their head.
ZIP_PACKAGES = (
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", b"word/"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", b"xl/"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx", b"ppt/"),
)
HEAD_BYTES = 8192

# The white space that Python's str.strip and \s know; all of it lies below U+3001.
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


@cache
def compatibility_folds() -> dict[str, str]:
    """Characters whose NFKC form consists only of what amounts and missing tokens use."""
    used = set("0123456789+-.()" + CURRENCY + THOUSANDS + UNICODE_MINUS + ZERO_WIDTH + WHITESPACE)
    used.update("".join(AMOUNT_MISSING))
    folds = {}
    for cp in range(0x80, 0x110000):
        char = chr(cp)
        folded = unicodedata.normalize("NFKC", char)
        if folded != char and used.issuperset(folded):
            folds[char] = folded
    return folds


@cache
def decimal_digits() -> dict[str, str]:
    """Decimal digits of other scripts, which NFKC leaves alone but a number may use."""
    chars = (chr(cp) for cp in range(0x80, 0x110000))
    return {
        c: str(unicodedata.decimal(c))
        for c in chars
        if unicodedata.category(c) == "Nd" and unicodedata.normalize("NFKC", c) == c
    }
