"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text (A-Z lower-cased) is its word n-grams, repeats included, joined by
single blanks; with fewer than n words the whole sequence is the only one.
Each is hashed with XXH64 (UTF-8, seed 42), and a fingerprint bit is 1 if it
is set in more than half of the hashes; without words the fingerprint is zero
and links like any other.  Two fingerprints link when they differ in at most
``radius`` bits (an even number).

Every distinct fingerprint emits all fingerprints within half the radius.  Two
that link meet in some such variant, midway between them; the rows are
shuffled by variant.  A variant's bucket holds at most as many fingerprints as
a ball of half the radius has points (65 for radius 2), however many documents
there are, and any two of them link.  So the neighbours in order within a
bucket keep all of it connected; these pairs are deduplicated, verified by
their differing bits and joined into components.

Copies cost nothing: only distinct fingerprints emit variants.  Texts are read
in runs of bounded size whatever their length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import PIECE_BYTES, reliable, slices
from tremor.llm.components import connected_components

SEED = 42                       # fixed by the task
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def word_runs(text: bytes, n: int, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The text's lower-cased words in runs of about ``limit`` bytes; each
    begins with the last n - 1 words of the one before."""
    carried, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > limit and (blank := _BLANK.search(text, at + limit)):
            end = blank.start()
        words = carried + text[at:end].lower().split()
        yield words
        carried = words[len(words) - n + 1:] if len(words) >= n else words
        at = end


def shingle_digests(text: bytes, n: int, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """XXH64 digests (8 bytes each, big-endian) of the text's word n-grams, by runs."""
    words, whole = [], True
    for words in word_runs(text, n, limit):
        if len(words) < n:
            continue
        whole = False
        line = b" ".join(words)
        after = list(itertools.accumulate(len(w) + 1 for w in words))
        yield b"".join([xxhash.xxh64_digest(line[a:b - 1], SEED) for a, b in zip([0, *after], after[n - 1:])])
    if whole and words:
        yield xxhash.xxh64_digest(b" ".join(words), SEED)


def fingerprints(texts: list[bytes | None], n: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    total = np.zeros(len(texts), np.int64)
    ones = np.zeros((len(texts), 64))

    def count(owners: list[int], digests: list[bytes]) -> None:
        places, where = np.unique(np.array(owners), return_inverse=True)
        sizes = np.array([len(d) // 8 for d in digests])
        owner = np.repeat(where, sizes) * 256
        hashed = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
        for byte in range(8):
            seen = np.bincount(owner + hashed[:, byte], minlength=256 * len(places)).reshape(-1, 256)
            ones[places, 8 * byte:8 * byte + 8] += seen @ _BITS
        np.add.at(total, np.array(owners), sizes)

    owners, digests, held = [], [], 0
    for k, text in enumerate(texts):
        for found in shingle_digests(text or b"", n):
            owners.append(k)
            digests.append(found)
            held += len(found)
            if held > PIECE_BYTES:
                count(owners, digests)
                owners, digests, held = [], [], 0
    if owners:
        count(owners, digests)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def document_fingerprints(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a bigint): one row per input row."""

    def run(batches):
        for batch in slices(batches):
            marks = fingerprints(batch.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id bigint, fp bigint"))


def ball_masks(bits: int) -> list[int]:
    """All 64-bit numbers of at most that many ones, as signed integers."""
    masks = [sum(1 << b for b in chosen) for size in range(bits + 1) for chosen in itertools.combinations(range(64), size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(marks: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a < b: verified links among the distinct values of ``fp`` that
    connect all that are linked at all (not every link of a bucket)."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even: half of it is what each fingerprint emits")
    mask = F.explode(F.lit(ball_masks(radius // 2)).cast("array<bigint>"))
    variants = (marks.select("fp").distinct().select("fp", mask.alias("mask"))
                .select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (variants.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null").distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def simhash_components(docs: DataFrame, n: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row per
    input row.

    component_id is the smallest doc_id reachable by links, the row's own
    included.  Null, empty and blank texts have fingerprint zero.  A row with
    a null doc_id has its fingerprint but takes no part in links
    (component_id null).  Rows that repeat a doc_id are joined by it.  An empty
    table gives an empty result; other columns are not read.
    """
    marks = reliable(document_fingerprints(docs, n))
    known = marks.where("doc_id is not null")
    first = reliable(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    by_id = known.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    label = reliable(connected_components(near_pairs(first, radius).union(by_id), "a", "b").withColumnRenamed("id", "fp"))
    smallest = label.join(first, "fp").groupBy("component").agg(F.min("least").alias("smallest"))
    named = reliable(first.join(label.join(smallest, "component"), "fp", "left")
                     .select("fp", F.coalesce("smallest", "least").alias("component_id"), "least", "most")
                     .where("least < most or component_id <> least").select("fp", "component_id"))
    return (marks.join(named, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
