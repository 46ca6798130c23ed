"""Quality rules: hashed n-gram likelihood ratio of a trusted corpus to the raw one.

Every document's byte n-grams (white space runs count as one blank, A-Z and
a-z are kept apart) are hashed into a fixed number of buckets.  Two smoothed
multinomials are counted, one over all documents, one over the trusted ones;
a document's score is the mean log ratio of its n-grams, so its length does
not matter, and it is kept when the score reaches a fixed threshold.  Counts
cover all texts in whole; they are summed per task before they are shuffled.

Base columns are fixed by the task; words are runs outside ASCII white
space.  A document fails the base rules with fewer than 20 words or more than
30 % of them in repeated windows, and then is not kept whatever its score.

Null text has no words.  A document without n-grams scores 0.  Repeated rows
count as often as they occur.  Without trusted rows all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_broadcast, pieces, slices, SPACE

SYMBOLS = b"#*$%&|<>"           # fixed by the task
MIN_WORDS, REPEAT_WINDOW = 20, 8
NGRAM = 3
BUCKET_BITS = 16
SMOOTHING = 1.0
THRESHOLD = -0.3                # mean log ratio that a kept document reaches

_CONTINUATION = bytes(range(0x80, 0xC0))

BASE_SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
               "n_repeat_words bigint")


def _ngram_buckets(group: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams at all positions of the joined texts and, per
    text, the first and one past the last position whose n-gram lies inside
    the text.  A text is framed by blanks."""
    joined = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
    bounds = np.cumsum([0] + [len(t) + 1 for t in group])
    space = SPACE[joined]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[bounds] = True                                # one blank between texts at least
    body = np.where(space, np.uint8(32), joined)[keep]
    place = (np.cumsum(keep) - 1)[bounds]
    code = np.zeros(max(0, len(body) - NGRAM + 1), np.uint32)
    for k in range(NGRAM):
        code = code << np.uint32(8) | body[k:len(code) + k]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    first = np.minimum(place[:-1], len(bucket))
    return bucket, first, np.maximum(first, np.minimum(place[1:] - NGRAM + 2, len(bucket)))


def _inside(bucket: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The buckets of n-grams that lie inside a text."""
    edge = np.zeros(len(bucket) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return bucket[np.cumsum(edge)[:-1] > 0]


def bucket_counts(docs: DataFrame, trusted: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over all rows and over rows whose boolean
    column ``trusted`` is true.  2**BUCKET_BITS numbers reach the driver."""

    def run(batches):
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in slices(batches):
            texts, good = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for chosen, row in ((good, 1), (~good, 0)):
                for _, group in pieces([texts[i] for i in np.flatnonzero(chosen)]):
                    total[row] += np.bincount(_inside(*_ngram_buckets(group)), minlength=1 << BUCKET_BITS)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])],
                                         names=["bucket", "other", "good"])

    sums = (docs.select("text", F.coalesce(F.col(trusted), F.lit(False)).alias("good"))
            .mapInArrow(run, "bucket bigint, other bigint, good bigint")
            .groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("good").alias("good")).toPandas())
    raw, good = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    raw[sums["bucket"]] = sums["other"] + sums["good"]
    good[sums["bucket"]] = sums["good"]
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Log ratio of the trusted to the raw multinomial.  The raw counts are
    scaled to the size of the trusted corpus and both get the same pseudo
    count, so buckets too rare to be expected there, and a small trusted
    corpus, say nothing."""
    if not good.sum():
        return np.zeros(len(raw))
    return np.log(good + SMOOTHING) - np.log(raw * (good.sum() / raw.sum()) + SMOOTHING)


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more.  ``ids`` number equal
    words alike.  Windows are ranked exactly by doubling (1, 2, 4, 8 words)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < window:
        pair = rank[:len(rank) - width] * (len(ids) + 1) + rank[width:]
        width *= 2
        if width < window:
            rank = np.unique(pair, return_inverse=True)[1]
    order = np.argsort(pair, kind="stable")
    same = pair[order][1:] == pair[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    np.subtract.at(cover, at + window, 1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    inside = b"".join(words)
    chars = len(inside.translate(None, _CONTINUATION))           # code points: bytes that begin one
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    repeat = repeated_words(ids) if len(number) < len(words) else 0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """One row per document row: base columns, score, base_failed, kept.
    With ``keep_columns`` the rows of ``docs`` that are kept, as they are."""
    table = ratio.astype(np.float64)
    names = docs.columns
    source = docs if keep_columns else docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                                   F.col("text").cast("string").alias("text"))
    at = source.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            rows, scores = [], []
            for _, group in pieces(batch.column(at).to_pylist()):
                bucket, first, last = _ngram_buckets(group)
                total = np.concatenate([[0.0], np.cumsum(table[bucket])])
                scores.append((total[last] - total[first]) / np.maximum(1, last - first))
                rows += [base_counts(t) for t in group]
            n = np.array(rows, np.int64).reshape(-1, 5)
            score = np.concatenate(scores) if scores else np.zeros(0)
            score = np.where(n[:, 0] > 0, score, 0.0)
            failed = (n[:, 0] < MIN_WORDS) | (100 * n[:, 4] > 30 * n[:, 0])
            kept = ~failed & (score >= threshold)
            if keep_columns:
                yield batch.filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(n[:, k].copy()) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(score)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    if keep_columns:
        return source.mapInArrow(run, docs.select(*names).schema)
    return source.mapInArrow(run, BASE_SCHEMA + ", base_failed boolean, kept boolean, score double")


def _with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc texts and whether any label of theirs calls them good."""
    good = (labels.select(F.col("doc_id").cast("bigint").alias("good_id"), "quality").where("quality = 1 and good_id is not null")
            .select("good_id").distinct())
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(bounded_broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
            .select("text", F.col("good_id").isNotNull().alias("trusted")))


def quality_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios with the documents labelled of good quality as the target."""
    return log_ratio(*bucket_counts(_with_trust(docs, labels), "trusted"))
