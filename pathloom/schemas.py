"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

SCAN_SCHEMA = T.StructType(
    [
        T.StructField("FILE", T.StringType()),
        T.StructField("FILESIZE", T.LongType()),
        T.StructField("CREATION_TIME", T.TimestampType()),
        T.StructField("MODIFICATION_TIME", T.TimestampType()),
        T.StructField("ISLINK", T.StringType()),
        T.StructField("TARGET", T.StringType()),
        T.StructField("STATUS", T.StringType()),
    ]
)

# header of an empty scan table: no STATUS column there
INIT_SCHEMA = T.StructType(SCAN_SCHEMA.fields[:6])

# Image extensions whose names may carry a frame number.
IMAGE_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".exr", ".dpx",
    ".cin", ".tx", ".ass", ".vdb", ".sgi", ".tga",
]

# The same storage root as each operating system sees it.
STORAGE_ROOTS = {"Windows": "F:/", "Linux": "/mnt/localF/", "Darwin": "/Volumes/localF/"}

# Path patterns a scan leaves out.
SCAN_EXCLUDES = [
    "*/jobs/IO/work/*", "*/jobs/PROD/*", "*/moviemaking/*", "*/IO/from*", "*/IO/to*",
    "*/data/setup*", "*/data/thumbs*",
]

# Text that marks a file as junk in the inventory job.
JUNK_TEXTS = ["~", ".db", ".tmp", "Thumbs", ".autosave", "DS_Store", "Thumbnail"]

# Defaults for unreadable times.
SCAN_DEFAULT_TIME = "1999-12-31 23:59:59"
ENTRY_DEFAULT_TIME = "1970-01-01 00:00:00"

# Delimiters around placeholders in path templates.
TOKEN_DELIMITERS = ["-", "_", ".", "/", ":", "\\"]

# Placeholders that a request leaves for the session step.
SESSION_PLACEHOLDERS = ["YYYYMMDD", "PKGVERSION3PADDED"]

REVIEW_STATES = ["pending", "valid", "invalid"]
