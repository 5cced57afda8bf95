"""Row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The names of block types, and below the fields of a block.
HEADING = "heading"
PARAGRAPH = "paragraph"
LIST_ITEM = "list_item"
TABLE = "table"

# The states a job can be in while it is being worked on.
ACTIVE_STATUSES = ("queued", "analyzing", "extracting", "ocr", "chunking", "translating", "assembling")
RESUMABLE_STATUSES = ("paused", "failed", "cancelled")

ROWS = T.ArrayType(T.ArrayType(T.StringType()))

BLOCK = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("marker", T.StringType()),
        T.StructField("rows", ROWS),
        T.StructField("bold", T.BooleanType()),
        T.StructField("italic", T.BooleanType()),
    ]
)
BLOCKS = T.ArrayType(BLOCK)
