"""Language identification in two steps: family, then language within it.

Features are square roots of hashed letter n-gram frequencies (1 to 3
letters, a blank behind each word), scaled to length one.  Families are told
apart by one-versus-one linear support vector machines, then the languages of
the winning family by their own; the winner has the most won comparisons, of
equal ones the larger sum of margins, then the smaller name.  A language
without a known family is a family of its own.

Only text and non-null lang of rows outside the held-out fold are learned
from: distinct texts in order of a hash of the text, at most TRAIN_ROWS in
all, divided evenly among the languages (a documented bound; the machines are
solved exactly in the dual space of that sample).  The score is the product
of the two steps' logistic win probabilities, against the closest rival.

Null texts and texts without a letter are ``und`` with score 0; without any
row to learn from every text is.  Every whole text is read; ties and repeated
rows are treated alike since a prediction depends on the text alone.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import bounded_broadcast, held_out, reliable, slices

TRAIN_ROWS = 2000               # texts learned from, in all
FEATURE_BITS = 12
RIDGE = 1e-2
UNDETERMINED = "und"

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
            "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic"}

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Per code point: is it a letter?"""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(one feature row per text, whether it has a letter).  Texts are taken
    in runs, so a long list needs bounded room beside its result."""
    size = 1 << FEATURE_BITS
    out = np.zeros((len(texts), size), np.float32)
    has = np.zeros(len(texts), bool)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars < 500_000) and end - at < 500:
            chars += len(texts[end] or "")
            end += 1
        _features(texts[at:end], out[at:end], has[at:end])
        at = end
    return out, has


def _features(texts: list[str | None], out: np.ndarray, has: np.ndarray) -> None:
    lower = [(t or "").lower() for t in texts]
    joined = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[joined]
    code = np.where(letter, joined, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]                       # one blank after each word
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])     # a text owns the blank behind it
    code, owner, letter = code[keep], owner[keep], letter[keep]
    if not len(code):
        return
    has[np.unique(owner[letter])] = True
    size = 1 << FEATURE_BITS
    shift = np.uint32(32 - FEATURE_BITS)
    base = owner.astype(np.int64) * size
    counts = np.zeros(len(texts) * size, np.int64)
    key = code
    for n in range(3):
        if n:
            key = key[:-1] * np.uint32(0x01000193) ^ code[n:]
            inside = owner[n:] == owner[:len(key)]
        else:
            inside = letter
        bucket = ((key + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift
        counts += np.bincount((base[:len(key)] + bucket)[inside], minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(texts), size).astype(np.float32))
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    out[:] = rows / np.maximum(norm, 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps in the dual
    space of the sample; the last weight is the bias.  y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    kernel = (x @ x.T).astype(np.float64)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    active, alpha = np.ones(len(y), bool), np.zeros(len(y))
    for _ in range(30):
        s = np.flatnonzero(active)
        alpha = np.zeros(len(y))
        # (K_ss + ridge * n / share) alpha = y on the examples inside the margin
        alpha[s] = np.linalg.solve(kernel[np.ix_(s, s)] + np.diag(ridge * len(y) / share[s]), y[s])
        now = y * (kernel @ alpha) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return x.T @ alpha


@dataclass
class Model:
    """groups: (names, pairs, weights); the first is over families."""

    families: dict[str, list[str]]
    steps: dict[str, tuple[list[str], list[tuple[int, int]], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        family, sure = _vote(x, *self.steps[""])
        names = np.empty(len(x), object)
        score = sure.copy()
        top = self.steps[""][0]
        for f in np.unique(family):
            rows = np.flatnonzero(family == f)
            step = self.steps[top[f]]
            own, p = _vote(x[rows], *step)
            names[rows] = [step[0][i] for i in own]
            score[rows] *= p
        return list(names), score


def _vote(x: np.ndarray, names: list[str], pairs: list[tuple[int, int]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner of one-versus-one comparisons and its worst win probability."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    margin = x @ weights.T
    wins, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for c, (i, j) in enumerate(pairs):
        wins[:, i] += margin[:, c] > 0
        wins[:, j] += margin[:, c] <= 0
        total[:, i] += margin[:, c]
        total[:, j] -= margin[:, c]
    best = np.argmax(wins + 1e-3 * np.tanh(total / len(names)), axis=1)
    worst = np.full(len(x), np.inf)
    for c, (i, j) in enumerate(pairs):
        worst = np.where(best == i, np.minimum(worst, margin[:, c]), worst)
        worst = np.where(best == j, np.minimum(worst, -margin[:, c]), worst)
    return best, 1 / (1 + np.exp(-4 * worst))


def _fit_step(names: list[str], rows: dict[str, np.ndarray]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    pairs = list(itertools.combinations(range(len(names)), 2))
    weights = [fit_svm(np.vstack([rows[names[i]], rows[names[j]]]),
                       np.concatenate([np.ones(len(rows[names[i]])), -np.ones(len(rows[names[j]]))])) for i, j in pairs]
    return names, pairs, np.array(weights, np.float32)


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text): an even, deterministic sample of the learnable rows."""
    known = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.col("lang").cast("string").alias("lang"))
             .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))))
    marks = reliable(known.select("lang", F.xxhash64("text").alias("mark")).distinct())
    counts = {r.lang: r["count"] for r in marks.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return known.select("lang", "text").limit(0)
    each = max(1, rows // len(counts))
    # the marks below each language's share of the hash range, then exactly ``each`` of them at most
    picks = None
    for lang, n in counts.items():
        bound = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * min(1.0, 1.3 * each / n + 40 / n)))
        part = marks.where((F.col("lang") == lang) & (F.col("mark") <= bound)).orderBy("mark").limit(each)
        picks = part if picks is None else picks.union(part)
    picks = bounded_broadcast(reliable(picks))
    return (known.withColumn("mark", F.xxhash64("text")).join(picks, ["lang", "mark"])
            .groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", "text"))


def fit(docs: DataFrame, families: dict[str, str] = FAMILIES, rows: int = TRAIN_ROWS) -> Model | None:
    sample = training_sample(docs, rows)

    def run(batches):
        for batch in slices(batches):
            x, has = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype(np.float16).tobytes() if ok else None for r, ok in zip(x, has)], pa.binary())],
                                             names=["lang", "row"])

    found = sorted((r.lang, bytes(r.row)) for r in sample.mapInArrow(run, "lang string, row binary").where("row is not null").collect())
    by_lang = {lang: np.array([np.frombuffer(r, np.float16) for _, r in g]).astype(np.float32)
               for lang, g in itertools.groupby(found, key=lambda r: r[0])}
    if not by_lang:
        return None
    members: dict[str, list[str]] = {}
    for lang in sorted(by_lang):
        members.setdefault(families.get(lang, lang), []).append(lang)
    top = sorted(members)
    steps = {"": _fit_step(top, {f: np.vstack([by_lang[x] for x in members[f]]) for f in top})}
    steps |= {f: _fit_step(members[f], by_lang) for f in top}
    return Model(members, steps)


def _predictor(model: Model | None):
    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if model is None:
            return names, score
        for a in range(0, len(texts), 500):
            x, has = features(texts[a:a + 500])
            if has.any():
                rows = a + np.flatnonzero(has)
                found, p = model.predict(x[has])
                score[rows] = p
                for i, name in zip(rows, found):
                    names[i] = name
        return names, score
    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    predict = _predictor(model)

    def run(batches):
        for batch in slices(batches):
            names, score = predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("bigint")
    return (docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double"))


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that got a language with at least that score."""
    predict = _predictor(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            names, score = predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
