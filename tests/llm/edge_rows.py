"""Rows that every document operator must take."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("_row", StringType())])

LONG = "long words here and there " * 40_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", None, 1, "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "s", None, "b"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "s", None, "b"),
    (3, None, None, None, None, None),
    (4, "", "en", "s", 0, "c"),
    (None, "a row without an id, ünïcode and <|endoftext|> inside  two spaces\t\r\n", "de", "s", 2, "d"),
    (5, LONG, "en", "s", 3, "e"),
    (6, "12345 67890 !!! 日本語 \x00   end", None, "s", 3, "f"),
    (7, "   ", "fr", "s", 3, "g"),
]
