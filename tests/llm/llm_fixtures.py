"""Small tables with every awkward case, and plain versions of the contracts."""

import re
import zlib

from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("node", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("component.id", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a\u00a0b \u2581 \u6f22\u5b57 \U0001f600\x00 end\n\nend",
    "same words here again " * 12,
    "Shared line of boilerplate text\nunique " + " ".join(f"u{i}" for i in range(40)),
    LONG,
    LONG + " extra",
    "x" * 5000,
]


def docs(spark, texts=ODD, repeat=True):
    """The texts under ids 1, 2, ..., then a NULL id, repeated rows and a repeated id."""
    rows = [
        (i, text, "en", f"s{i % 3}" if i % 4 else None, 1, "n", "r", "c")
        for i, text in enumerate(texts, start=1)
    ]
    if repeat:
        rows += [rows[4], rows[5], (None, "lost and found " * 9, None, None, None, "n", "r", "c")]
        rows += [(2, "another text under an id that is taken", "en", "s1", 1, "n", "r", "c")]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall((text or "").encode().lower())


def crc(value):
    return zlib.crc32(str(value).encode() if value is not None else b"")
