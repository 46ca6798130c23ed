"""Small document frames for the operator tests."""

from __future__ import annotations

import random
import zlib

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int, base: int = 500) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(base)}" for _ in range(n))


def documents(spark, rows, clash: bool = False):
    """rows: (doc_id, text) or (doc_id, text, lang).  clash: more columns, named
    as the operators name theirs."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for name in ("key", "mark", "shard", "rep", "component", "score", "kept", "h1", "ids", "grams", "good", "part", "rank"):
            df = df.withColumn(name, F.lit("x"))
    return df


ODD_ROWS = [
    (None, "a row without an id, of seven words"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"),
    (6, "same text again here"), (7, "same text again here"), (7, "same text again here"), (8, "\U0001f600 émoji ÀÉÎ ﬁ ß İ"),
    (9, "x" * 50_000), (10, words(3, 30_000)), (11, "%41%zz \\u00e9 \\ud83d\\ude00 ===="), (12, "\x00\x1c\x85 odd \u2028 spaces"),
]


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
