"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of a whole text: densities of lexicon words, of words beginning with
lexicon stems and of words that become such once digits and signs are read as
letters; second-person words and those near a lexicon word; shares of
capitals, punctuation and single signs; words that hide letters behind signs
or digits, and drawn-out letters; length.  The lexicon is a short fixed list
and what a training sample adds: words and word beginnings far more frequent
in texts labelled toxic.

Labels are read from rows outside the held-out fold only, and of those at most
CLASS_ROWS per label in order of a hash of the id (a documented bound on what
the classifier is fitted on; the classes are weighted back to their shares).
Remainders 0 and 1 of the fold hash choose the lexicon and fit the trees,
remainder 3 fits the calibration.  doc_id, lang and source are no features.

Empty and null texts get the score of their features (no words).  Several
labels of one document count as its largest; documents without label are
scored alike.  Without labels all scores are 0, with labels of one value all
scores are that value.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import held_out, reliable, slices

CLASS_ROWS = 3000               # labelled texts of each class that are learned from
LEXICON_TERMS = 2000
MIN_TOXIC_TEXTS, WEAK_TOXIC_TEXTS = 4, 12
MIN_LOG_ODDS, STRONG_LOG_ODDS = 2.5, 4.0        # a term below STRONG is weak
STEMS = (4, 5, 6)               # lengths of word beginnings that may be learned
NEAR = 5                        # words between second person and lexicon word
TREES, DEPTH, STEP = 20, 3, 0.2
DECISION = 0.3                  # fixed by the task
CACHE = 400_000

INSULTS = {"idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "imbecile", "vermin", "filth"}
SECOND_PERSON = {"you", "your", "yours", "yourself", "tu", "te", "toi", "ton", "vous", "votre", "du", "dich", "dir", "dein",
                 "deine", "ihr", "euch", "usted", "ustedes", "ti", "tus"}
_READ_AS = str.maketrans("013457@$!|", "oieastasii")
_CORE = re.compile(r"^\W*(.*?)\W*$", re.S)
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_SIGNS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])

FEATURES = ("words", "lexicon", "stems", "read_as", "hits", "second", "near", "capitals", "punctuation", "exclaim",
            "question", "hidden", "drawn", "weak", "weak_hits")
WORD, STEM, READ, SECOND, HIDDEN, DRAWN, WEAK = 1, 2, 4, 8, 16, 32, 64


class Marker:
    """Marks white-space-free chunks with what they are; remembers chunks."""

    def __init__(self, lexicon: frozenset[str]):
        strong = {t for t in lexicon if t[0] != "~"}
        weak = {t[1:] for t in lexicon if t[0] == "~"}
        self.lexicon = strong | INSULTS
        self.stems = frozenset(t[:-1] for t in strong if t.endswith("*"))
        self.weak, self.weak_stems = frozenset(weak), frozenset(t[:-1] for t in weak if t.endswith("*"))
        self.known: dict[str, int] = {}

    def _hit(self, word: str) -> int:
        if word in self.lexicon:
            return WORD
        starts = [word[:n] for n in STEMS if len(word) > n]
        if any(x in self.stems for x in starts):
            return STEM
        return WEAK if word in self.weak or any(x in self.weak_stems for x in starts) else 0

    def mark(self, chunk: str) -> int:
        core = _CORE.match(chunk)[1]
        if not core:
            return 0
        if core.isalpha():
            found = self._hit(core) | (SECOND if core in SECOND_PERSON else 0)
        else:
            parts = re.findall(r"[^\W\d_]+", core)
            found = reduce(int.__or__, (self._hit(p) | (SECOND if p in SECOND_PERSON else 0) for p in parts), 0)
            if parts and re.search(r"[^\W\d_][\d@$*!|._-]+[^\W\d_]", core):
                found |= HIDDEN
            read = core.translate(_READ_AS)
            if any(self._hit(r) & (WORD | STEM) for r in (read, re.sub(r"[\W_]", "", read))):
                found |= READ
        return found | (DRAWN if _DRAWN.search(core) else 0)

    def marks(self, chunks: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(codes < 0)
        if len(new):
            if len(self.known) > CACHE:
                self.known.clear()
            for c in {chunks[i] for i in new}:
                self.known[c] = self.mark(c)
            codes[new] = [self.known[chunks[i]] for i in new]
        return codes

    def features(self, text: str | None) -> np.ndarray:
        text = text or ""
        codes = self.marks(text.lower().split())
        n = max(1, len(codes))
        lexicon, stem, read, second, hidden, drawn, weak = (
            np.count_nonzero(codes & b) for b in (WORD, STEM, READ, SECOND, HIDDEN, DRAWN, WEAK))
        hit = (codes & (WORD | STEM | READ)) > 0
        near = 0
        if second and hit.any():
            reach = np.concatenate([[0], np.cumsum(hit)])
            at = np.flatnonzero(codes & SECOND)
            near = np.count_nonzero(reach[np.minimum(len(codes), at + NEAR + 1)] - reach[np.maximum(0, at - NEAR)])
        size = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        chars = max(1, len(text))
        return np.array([math.log1p(len(codes)), lexicon / n, stem / n, read / n, math.log1p(np.count_nonzero(hit)), second / n, near / n,
                         size[65:91].sum() / chars, size[_SIGNS].sum() / chars, size[33] / chars, size[63] / chars, hidden / n, drawn / n,
                         weak / n, math.log1p(weak)])


_markers: dict[frozenset, Marker] = {}


def _marker(lexicon: frozenset[str]) -> Marker:
    if lexicon not in _markers:
        _markers.clear()
        _markers[lexicon] = Marker(lexicon)
    return _markers[lexicon]


def feature_rows(docs: DataFrame, lexicon: frozenset[str], carried: list[str]) -> DataFrame:
    """The carried columns and the features of every row of ``docs``."""
    types = dict(docs.dtypes)

    def run(batches):
        marker = _marker(lexicon)
        for batch in slices(batches):
            rows = np.array([marker.features(t) for t in batch.column(len(carried)).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), *(pa.array(c.copy()) for c in rows.T)],
                                             names=[*carried, *FEATURES])

    schema = ", ".join([f"{c} {types[c]}" for c in carried] + [f"{f} double" for f in FEATURES])
    return docs.select(*carried, "text").mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words, and beginnings ending in ``*``, typical of toxic texts; weak ones
    start with ``~``.  sample: toxic, text (bounded by its maker)."""

    def run(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in slices(batches):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(re.findall(r"[^\W\d_]{3,}", (text or "").lower()))
                seen[toxic].update(words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        terms = [t for t in seen[1]]
        clean = [seen[0][t] for t in terms] + [n for t, n in seen[0].items() if t not in seen[1]]
        every = terms + [t for t in seen[0] if t not in seen[1]]
        toxic = [seen[1][t] for t in terms] + [0] * (len(every) - len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())],
                                         names=["term", "toxic", "clean"])

    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    odds = (F.log((F.col("toxic") + 0.5) / F.lit(t + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(c + 1.0)))
    found = (sample.select("toxic", "text").mapInArrow(run, "term string, toxic bigint, clean bigint")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= MIN_TOXIC_TEXTS) & (odds >= STRONG_LOG_ODDS)
                    | (F.col("toxic") >= WEAK_TOXIC_TEXTS) & (odds >= MIN_LOG_ODDS))
             .select("term", odds.alias("odds")).orderBy(F.desc("odds"), "term").limit(LEXICON_TERMS).collect())
    return frozenset(r.term if r.odds >= STRONG_LOG_ODDS else "~" + r.term for r in found)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = CLASS_ROWS) -> DataFrame:
    """(part, toxic, weight, text) of the rows learned from; part is the fold remainder."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = reliable(labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
                     .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
                     .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = None
    for toxic, n in sizes.items():
        some = (known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
                .withColumn("weight", F.lit(n / min(n, rows))))
        picks = some if picks is None else picks.union(some)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if picks is None:
        return text.limit(0).select(F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("toxic"), F.lit(1.0).alias("weight"), "text")
    # at most two classes of ``rows`` ids: a proven bound
    return text.join(F.broadcast(picks), "doc_id").select(part.cast("bigint").alias("part"), "toxic", "weight", "text")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sample = reliable(training_sample(docs, labels))
    seen = {r.toxic for r in sample.select("toxic").distinct().collect()}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = held_out(F.col("doc_id")).alias("held_out")
    if len(seen) < 2:
        constant = float(max(seen, default=0))
        return rows.select("doc_id", fold, F.lit(constant).alias("score"), F.lit(int(constant >= DECISION)).alias("predicted"))

    fit_part = F.col("part") != 3
    lexicon = learn_lexicon(sample.where(fit_part))
    known = reliable(feature_rows(sample, lexicon, ["part", "toxic", "weight"])
                     .withColumn("label", F.col("toxic").cast("double")).coalesce(4))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train, check = known.where(fit_part), known.where(~fit_part)
    if train.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        train = check = known                       # too few rows to keep a part for calibration
    trees = GBTClassifier(labelCol="label", weightCol="weight", featuresCol="features", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=STEP, maxBins=64, seed=11).fit(assemble.transform(train))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(
        trees.transform(assemble.transform(check)).select(margin, "label", "weight"))
    scored = trees.transform(assemble.transform(feature_rows(rows, lexicon, ["doc_id"]))).select("doc_id", margin)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("prediction", F.lit(0.0))))
    return (curve.transform(scored).select("doc_id", fold, score.alias("score"))
            .withColumn("predicted", (F.col("score") >= DECISION).cast("int")))
