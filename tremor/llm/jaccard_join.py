"""Word n-gram Jaccard join by size: subsets for small sets, inverted lists for large.

A document's set holds its distinct word n-grams (words of A-Z lower-cased
text between ASCII white space; with fewer than n words the whole sequence is
the only element; without words the set is empty and links with nothing).
Two documents link when ``den * |A & B| >= num * |A | B|``.

Candidates share a key:

* light sets, below the boundary: every subset of a size that some light
  pair must have in common is a key (exactly the linked pairs share one);
* heavy sets: single n-grams make poor list heads, since passages that many
  documents share would put all of these into one list.  The n-gram space is
  cut into blocks instead, and the lists are kept by block content.  There are
  more blocks than a linked pair of that size band can differ in, by a margin,
  so a linked pair agrees on more than ``spare`` whole blocks; a pair that
  shares fewer lists (empty blocks aside) is no candidate.  A set with more
  empty blocks than that lists them too.  A band's lists hold its own sets
  and the smaller ones that may link with them; two of the latter meet in
  their own band;
* the boundary is the least size whose subsets cost more rows than its lists
  (a list row counts twice: it may be shared without a link).

Lists are read in sorted order as streams.  Short ones (SHORT_LIST) give their
pairs, which are counted and held against the margin.  Of its longer ones,
where pairs would grow with the square, a set that must share m lists with a
partner leaves its m - 1 longest: the least of the shared lists in an order
common to all sets (by length) is left by neither.  So passages that many
documents share, and little else, are left by all of them; a pair is excused
as many lists as it may have left.  What then is short gives pairs, and the
rest a star, whose pairs are all compared later.  Of the pairs that share
enough, only a spanning forest of each list's goes on, fewer than its members.

Candidates are joined into groups, whose sets are compared exactly, by sparse
products over the n-grams that occur twice, in cells of bounded size.  A large
group is dealt into chunks, each compared within itself and with the group's
first set; then only the sets outside the largest class found meet all others,
in cells of two chunks.  Only a spanning forest of the links leaves a cell.
Copies of one set are one member with that.

Nothing is capped or sampled.  A very large group of texts that resemble but
do not link, in most of their blocks, costs comparisons with the square of its
distinct texts.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import bounded_broadcast, mix64, pieces, reliable, slices, WordStream
from tremor.llm.components import connected_components
from tremor.session import checkpoint_dir

CHUNK_SETS = 512                # sets in a chunk of a large candidate group
SHORT_LIST = 128                # members of a list that gives all its pairs
HASHED_BYTES = 1 << 18          # text whose n-grams are hashed at once: some 100 bytes of memory each
FOREST_CELLS = 1 << 20          # entries of a cell's matrices held at once beside the intersections
_STAR = 1 << 20                 # stands for enough shared lists
_PAIR_SCHEMA = "a bigint, b bigint, n bigint, need bigint, part int"
_EMPTY = np.uint64(0x5851F42D4C957F2D)


class Scheme:
    """Key plan for a threshold num/den; everything follows from a set's size."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.boundary = self._boundary()
        self.levels: list[tuple[int, int, int, int]] = []      # smallest, largest size, blocks, spare blocks
        self._next = self.boundary
        self._known: dict[int, list[int]] = {}

    def needed(self, a: int, b: int) -> int:
        """Least intersection of a linked pair of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def largest(self, a: int) -> int:
        return a * self.den // self.num

    def smallest(self, b: int) -> int:
        return -(-b * self.num // self.den)

    def subset_sizes(self, s: int, below: int) -> list[int]:
        partners = range(self.smallest(s), min(self.largest(s), below - 1) + 1)
        return sorted({self.needed(s, p) for p in partners})

    def _level(self, low: int) -> tuple[int, int, int, int]:
        top = self.largest(low)
        differ = 2 * top * (self.den - self.num) // (self.den + self.num)
        size, spare = self.smallest(low), 1
        while spare <= differ + 1:                    # until more empty blocks than that are rare
            m = differ + 1 + spare
            p = (1 - 1 / m) ** size                   # that a block is empty
            if m * p > 30:
                rare = spare >= m * p + 5 * math.sqrt(m * p) + 5
            else:
                term = total = (1 - p) ** m
                for j in range(spare):
                    term *= (m - j) / (j + 1) * p / (1 - p)
                    total += term
                rare = 1 - total < 1e-6
            if rare:
                break
            spare += 1
        return size, top, differ + 1 + spare, spare

    def _boundary(self) -> int:
        s = 1
        while True:
            subsets = sum(math.comb(s, c) for c in self.subset_sizes(s, self.largest(s) + 1))
            lists = 2 * (self._level(s)[2] + self._level(self.largest(s) + 1)[2])
            if subsets > lists:
                return s
            s += 1

    def levels_of(self, s: int) -> list[int]:
        """Levels in which a set of size s meets its partners."""
        if s not in self._known:
            while self.smallest(self._next) <= s:
                self.levels.append(self._level(self._next))
                self._next = self.levels[-1][1] + 1
            self._known[s] = [i for i, (low, top, _, _) in enumerate(self.levels) if low <= s <= top]
        return self._known[s]

    def is_own(self, i: int, s: int) -> bool:
        """Whether a set of size s belongs to level i's own band."""
        return s >= (self.levels[i - 1][1] + 1 if i else self.boundary)


@lru_cache(maxsize=4)
def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den)


def _salt(*numbers: int) -> np.uint64:
    x = 0
    for n in numbers:
        x = (x * 0x100000001B3 + n + 1) % (1 << 64)
    return mix64(np.array([x], np.uint64))[0]


def subset_keys(h: np.ndarray, size: int) -> np.ndarray:
    """Keys of all subsets of the given size: sums of the hashes kept."""
    total = h.sum(dtype=np.uint64)
    drop = len(h) - size
    if drop == 0:
        sums = np.array([total])
    elif drop == 1:
        sums = total - h
    else:
        gone = np.array(list(itertools.combinations(range(len(h)), drop)))
        sums = total - h[gone].sum(axis=1, dtype=np.uint64)
    return mix64(sums + _salt(1, size))


def block_keys(h: np.ndarray, level: int, blocks: int, spare: int) -> tuple[np.ndarray, int]:
    """Keys of the blocks of a sorted set at a level, and how many lists a
    linked pair with it shares at least, as far as this set tells."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    filled = block[start]
    empty = blocks - len(filled)
    with np.errstate(over="ignore"):
        keys = mix64(np.add.reduceat(mix64(h), start) + (filled + np.uint64(1)) * _salt(2, level))
        if empty > spare:
            none = np.setdiff1d(np.arange(blocks, dtype=np.uint64), filled)
            keys = np.concatenate([keys, mix64((none + np.uint64(1)) * _salt(2, level) + _EMPTY)])
    return keys, max(1, spare + 1 - empty)


def set_keys(h: np.ndarray, plan: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a sorted set of hashes, and per key 2 * (lists that a linked
    pair shares at least) + (whether the set is at home in that list).  Pairs
    of which neither is at home meet elsewhere."""
    s = len(h)
    keys, codes = [], []
    if s < plan.boundary:
        keys += [subset_keys(h, c) for c in plan.subset_sizes(s, plan.boundary)]
        codes += [np.full(len(k), 2 * 1 + 1, np.int32) for k in keys]
    for i in plan.levels_of(s):
        _, _, blocks, spare = plan.levels[i]
        found, need = block_keys(h, i, blocks, spare)
        keys.append(found)
        codes.append(np.full(len(found), 2 * need + plan.is_own(i, s), np.int32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(keys), np.concatenate(codes)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each whole text's word n-grams."""
    for _, group in pieces(texts, HASHED_BYTES):
        s = WordStream(group)
        words = len(s.start)
        if words >= n:
            i = np.arange(words - n + 1)
            grams = s.hash_spans(i, i + n - 1)
        for k in range(len(group)):
            a, b = s.words(k)
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield s.hash_spans(np.array([a]), np.array([b - 1]))
            else:
                yield np.zeros(0, np.uint64)


def _set_hash(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0,
                int(mix64(h ^ _EMPTY).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit hash of each document's set."""

    def run(batches):
        for batch in slices(batches):
            size, one, two = [], [], []
            for h in shingle_sets(batch.column(1).to_pylist(), n):
                a, b = _set_hash(h)
                size.append(len(h))
                one.append(a)
                two.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["doc_id", "n_shingles", "h1", "h2"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def key_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, doc_id, code) of all documents with an id (codes as in
    ``set_keys``); a task lists one of equal sets."""

    def run(batches):
        plan = scheme(num, den)
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            keys, codes, sizes, ids = [], [], [], []
            for doc_id, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), n)):
                if not len(h) or (mark := _set_hash(h)) in seen:
                    continue
                seen.add(mark)
                found, code = set_keys(h, plan)
                keys.append(found)
                codes.append(code)
                sizes.append(len(found))
                ids.append(doc_id)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), sizes)),
                     pa.array(np.concatenate(codes))], names=["key", "doc_id", "code"])

    return _texts(docs).where("doc_id is not null").mapInArrow(run, "key bigint, doc_id bigint, code int")


def _short_pairs(key: np.ndarray, doc: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(a, b, shared lists, needed, part) of the pairs inside short lists;
    part is the least mark of the shared lists."""
    out = [np.zeros((0, 5), np.int64)]
    for s in range(2, SHORT_LIST + 1):
        at = start[size == s]
        if not len(at):
            continue
        i, j = np.triu_indices(s, 1)
        a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        ok = ((code[a] | code[b]) & 1 > 0) & (doc[a] != doc[b])
        a, b = a[ok], b[ok]
        out.append(np.stack([doc[a], doc[b], np.ones(len(a), np.int64), np.maximum(code[a], code[b]) >> 1, _mark(key[a])], 1))
    pairs = np.concatenate(out)
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
    return np.stack([pairs[new, 0], pairs[new, 1], np.add.reduceat(pairs[:, 2], new), np.maximum.reduceat(pairs[:, 3], new),
                     np.minimum.reduceat(pairs[:, 4], new)], 1)


def _mark(key: np.ndarray) -> np.ndarray:
    """32 bits of a list's key or a set's id; lists that share a mark do no harm."""
    return key >> 32


def _list_rows(keys: DataFrame, split: bool) -> DataFrame:
    """(a, b, n, need, part): the pairs of short lists, and of long lists their
    members as (doc_id, key, 0, -code, 0) if ``split``, else stars.  A pair's
    part is that of a list, a star's that of the member.  Lists are streamed;
    at most SHORT_LIST members of one are held."""

    def long_rows(first, key, doc, code):
        if split:
            none = np.zeros(len(doc), np.int64)
            return np.stack([doc, key, none, -code, none], 1)
        more = np.unique(doc)
        more = more[more != first]
        return np.stack([np.full(len(more), first), more, np.full(len(more), _STAR), np.ones(len(more), np.int64), _mark(more)], 1)

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]     # a list that may go on
        long_key, first = None, None                                                      # a long list that may go on

        def work(key, doc, code, last):
            nonlocal held, long_key, first
            out = []
            if long_key is not None and len(key):
                same = int(np.searchsorted(key != long_key, True)) if (key != long_key).any() else len(key)
                out.append(long_rows(first, key[:same], doc[:same], code[:same]))
                key, doc, code = key[same:], doc[same:], code[same:]
                if len(key):
                    long_key = None
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            if len(start) and not last and size[-1] <= SHORT_LIST:
                held = [x[start[-1]:] for x in (key, doc, code)]
                start, size = start[:-1], size[:-1]
            else:
                held = [x[:0] for x in (key, doc, code)]
                if len(start) and not last:
                    long_key, first = key[start[-1]], doc[start[-1]]
            out.append(_short_pairs(key, doc, code, start, size))
            for a, n in zip(start[size > SHORT_LIST], size[size > SHORT_LIST]):
                out.append(long_rows(doc[a], key[a:a + n], doc[a:a + n], code[a:a + n]))
            rows = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, c].copy()) for c in range(4)] + [pa.array(rows[:, 4].astype(np.int32))],
                                              names=["a", "b", "n", "need", "part"])

        for batch in batches:
            columns = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for c, h in enumerate(held)]
            yield work(*columns, False)
        yield work(*held, True)

    return (keys.repartition("key").sortWithinPartitions("key", "doc_id")
            .mapInArrow(run, _PAIR_SCHEMA))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): pairs that share enough lists, and stars of long lists."""
    return (_list_rows(keys, False).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
            .where("n >= need").select("a", "b"))


def part_forests(pairs: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the pairs of each ``part``, so that what
    they join stays joined.  The pairs of a short list, whose number grows with
    the square of its members, become fewer than these.  A task streams its
    pairs and holds the sets of one part, some SHORT_LIST."""

    def run(batches):
        part, parent = None, {}

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            keep = []
            for a, b, p in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if p != part:
                    part, parent = p, {}
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
                keep.append(x != y)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.select("a", "b", "part").repartition("part").sortWithinPartitions("part", "a", "b")
            .mapInArrow(run, "a bigint, b bigint"))


def split_candidates(keys: DataFrame) -> DataFrame:
    """(a, b): as ``candidate_pairs``, but a set leaves the longest of its long
    lists, one less than a partner must share with it, before these give
    stars.  Every pair that shares enough lists is joined, itself, by a star or
    through other pairs: of these only forests are kept (``part_forests``)."""
    spark, path = keys.sparkSession, f"{checkpoint_dir(keys.sparkSession)}/jaccard-lists-{uuid.uuid4().hex}"
    _list_rows(keys, True).write.parquet(path)              # read three times, by columns
    found = spark.read.schema(_PAIR_SCHEMA).parquet(path)
    pairs = found.where("need >= 0")
    long = found.where("need < 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), (-F.col("need")).cast("int").alias("code"))
    length = reliable(long.groupBy("key").agg(F.count(F.lit(1)).alias("length")))
    longest = Window.partitionBy("doc_id", "code").orderBy(F.col("length").desc(), "key")
    ranked = reliable(long.join(bounded_broadcast(length), "key")
                      .select("key", "doc_id", "code", (F.row_number().over(longest) < F.floor(F.col("code") / 2)).alias("leaves")))
    kept = ranked.where(~F.col("leaves")).select("key", "doc_id", "code")
    left = (ranked.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("lists"), F.count_if("leaves").alias("gone"))
            .groupBy("doc_id").agg(F.sum("lists").alias("lists"), F.max("gone").alias("gone")).where("gone > 0"))
    left = bounded_broadcast(reliable(left))
    of_a, of_b = (left.select(F.col("doc_id").alias(c), F.col("lists").alias(f"lists_{c}"), F.col("gone").alias(f"gone_{c}")) for c in "ab")
    # lists are left from the long end, so a pair misses no more than the one that left more of them
    excused = F.least(F.greatest("gone_a", "gone_b"), "lists_a", "lists_b")
    enough = (pairs.union(_list_rows(kept, False)).groupBy("a", "b")
              .agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.min("part").alias("part"))
              .join(of_a, "a", "left").join(of_b, "b", "left")
              .where(F.col("n") >= F.col("need") - F.when(F.col("lists_a").isNotNull() & F.col("lists_b").isNotNull(), excused).otherwise(0)))
    return part_forests(enough)


def link_forest(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Label of each set after joining all linked pairs among ``left`` (or
    between ``left`` and ``right``): the first index of its group."""
    sets = left + (right or [])
    g = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(g), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(shared.sum())
    inter = np.zeros((g, g), np.float32)
    step = max(64, min(4096, FOREST_CELLS // g))
    for c in range(0, width, step):
        a, b = np.searchsorted(column, [c, c + step])
        x = np.zeros((g, min(step, width - c)), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        inter += x @ x.T
    link = np.zeros((g, g), bool)
    rows = max(1, FOREST_CELLS // g)
    for r in range(0, g, rows):
        shares = np.rint(inter[r:r + rows]).astype(np.int64)
        link[r:r + rows] = den * shares >= num * (size[r:r + rows, None] + size[None, :] - shares)
    if right is not None:
        link[:len(left), :len(left)] = False
        link[len(left):, len(left):] = False
    np.fill_diagonal(link, True)
    label = np.arange(g)
    while True:
        new = np.concatenate([np.where(link[r:r + rows], label[None, :], g).min(axis=1) for r in range(0, g, rows)])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def cell_links(cells: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b) spanning forests of the links inside cells.  cells: component,
    i, j, side, doc_id, text, dealt and sorted by cell."""

    def solve(ids, sides, sets):
        left = [k for k, s in enumerate(sides) if s == 0]
        right = [k for k, s in enumerate(sides) if s == 1]
        order = left + right
        label = link_forest([sets[k] for k in left], [sets[k] for k in right] if right else None, num, den)
        for at, to in enumerate(label):
            if at != to:
                yield ids[order[at]], ids[order[to]]

    def run(batches):
        cell, ids, sides, sets = None, [], [], []
        for batch in slices(batches):
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            side, doc = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            raw = [np.frombuffer(x, np.uint64) for x in batch.column(5).to_pylist()]
            out = []
            for k, key in enumerate(keys):
                if key != cell:
                    if len(ids) > 1:
                        out += solve(ids, sides, sets)
                    cell, ids, sides, sets = key, [], [], []
                ids.append(doc[k])
                sides.append(side[k])
                sets.append(raw[k])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        if len(ids) > 1 and (out := list(solve(ids, sides, sets))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return (cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "doc_id")
            .mapInArrow(run, "a bigint, b bigint"))


def set_column(docs: DataFrame, n: int, carried: list[str]) -> DataFrame:
    """The carried long columns and each row's set as binary (uint64, sorted)."""

    def run(batches):
        for batch in slices(batches):
            sets = [h.tobytes() for h in shingle_sets(batch.column(len(carried)).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(carried))] + [pa.array(sets, pa.binary())],
                                             names=[*carried, "grams"])

    return docs.select(*carried, "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in carried) + ", grams binary")


def _open_cells(large: DataFrame, links: DataFrame) -> DataFrame:
    """component, doc_id, chunk, apart, meets of the large groups that the
    links do not join yet.  The sets outside a group's largest class have the
    first chunks and meet all chunks; those inside have the others and meet
    only the first ones."""
    label = connected_components(links, "a", "b").select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    labelled = reliable(large.select("component", "doc_id").join(label, "doc_id", "left").select(
        "component", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    classes = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("g"))
    group = (classes.groupBy("component").agg(F.max(F.struct("g", "label")).alias("most"), F.sum("g").alias("g"))
             .where("g > most.g").select("component", F.col("most.label").alias("core"),
                                         F.ceil((F.col("g") - F.col("most.g")) / CHUNK_SETS).alias("outer"),
                                         F.ceil(F.col("most.g") / CHUNK_SETS).alias("inner")))
    hashed, inside = F.xxhash64("doc_id"), F.col("label") == F.col("core")
    return labelled.join(group, "component").select(
        "component", "doc_id", F.when(inside, F.col("outer") + F.pmod(hashed, "inner")).otherwise(F.pmod(hashed, "outer")).alias("chunk"),
        F.lit(1).cast("bigint").alias("apart"), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")).alias("meets"))


def _compare(docs: DataFrame, dealt: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links inside the cells of ``dealt`` (component, doc_id, chunk, apart,
    meets).  With apart = 1 a set meets the first ``meets`` chunks, in cells of
    two chunks; with apart = 0 it is in its own chunk's cell, or in the first
    ``meets`` ones if there are any."""
    texts = _texts(docs).join(bounded_broadcast(dealt), "doc_id")
    with_sets = set_column(texts, n, ["component", "doc_id", "chunk", "apart", "meets"])
    others = F.when(F.col("meets") > 0, F.expr("sequence(0L, greatest(meets, 1L) - 1)")).otherwise(F.array("chunk"))
    cells = with_sets.select("component", "doc_id", "chunk", "apart", "grams", F.explode(others).alias("other"))
    first = F.when(F.col("apart") == 1, F.least("chunk", "other")).otherwise(F.col("other"))
    second = F.when(F.col("apart") == 1, F.greatest("chunk", "other")).otherwise(F.col("other"))
    side = F.when((F.col("apart") == 1) & (F.col("chunk") > F.col("other")), 1).otherwise(0).cast("bigint")
    return cell_links(cells.select("component", first.alias("i"), second.alias("j"), side.alias("side"), "doc_id", "grams"), n, num, den)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    component_id is the smallest doc_id reachable by links, the row's own
    included.  A row with an empty set links with nothing and keeps its own
    id; a null doc_id takes no part (component_id null).  Rows that repeat a
    doc_id count as joined by it.  An empty table gives an empty result.
    """
    sets = reliable(document_sets(docs, n))
    real = sets.where("doc_id is not null and n_shingles > 0")
    classes = (real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
               .where("rep < top").select("h1", "h2", "n_shingles", "rep"))
    member = reliable(real.join(classes, ["h1", "h2", "n_shingles"], "left")
                      .select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct())
    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    near = split_candidates(key_rows(docs, n, num, den))
    groups = connected_components(near.union(copies), "a", "b")
    reps = (groups.join(member.where("doc_id = rep").select(F.col("doc_id").alias("id")).distinct(), "id")
            .select(F.col("id").alias("doc_id"), "component"))
    size = reps.groupBy("component").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    cand = reliable(reps.join(size, "component").select("component", "doc_id", F.ceil(F.col("g") / CHUNK_SETS).alias("chunks")))
    # each chunk within itself and with the group's first set
    chunk = F.pmod(F.xxhash64("doc_id"), "chunks")
    links = reliable(_compare(docs, cand.select(
        "component", "doc_id", chunk.alias("chunk"), F.lit(0).cast("bigint").alias("apart"),
        F.when(F.col("doc_id") == F.col("component"), F.col("chunks")).otherwise(0).alias("meets")), n, num, den))
    large = cand.where("chunks > 1")
    if not large.isEmpty():
        links = links.union(_compare(docs, reliable(_open_cells(large, links)), n, num, den))
    label = connected_components(links.union(copies), "a", "b").select(F.col("id").alias("doc_id"), "component")
    return (sets.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id"))
                    .otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that are the first of their group: the smallest
    doc_id (none comes last), then the smallest row key.  A row's key is a
    64-bit hash of doc_id and text, so rows without id and rows that share one
    take part each, and of rows alike in both one stays.  Rows without words
    all stay."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    rows = docs.select(key.alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text"))
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), n, num, den).where("n_shingles > 0")
    counted = reliable(found.groupBy(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).agg(F.count(F.lit(1)).alias("times")))
    # groups of more than one row; only these need the ids again
    grouped = reliable(counted.join(counted.groupBy("component").agg(F.count(F.lit(1)).alias("g")).where("g > 1").drop("g"), "component"))
    place = F.struct(F.col("id").isNull().alias("without"), "id", "row")
    placed = grouped.join(rows.select("row", "id").distinct(), "row").select("row", "component", place.alias("place"))
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    row, number = free_names(docs.columns, "row", "number")
    gone = reliable(placed.join(first, "component").where("place <> first").select(F.col("row").alias(row)))
    again = reliable(counted.where("times > 1").select(F.col("row").alias(row)))
    kept = docs.withColumn(row, key).join(bounded_broadcast(gone), row, "left_anti")
    again = bounded_broadcast(again)
    once = Window.partitionBy(row).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [row])
    repeated = kept.join(again, row, "left_semi").withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).drop(number)
    return kept.join(again, row, "left_anti").unionByName(repeated).drop(row)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until no column has them in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
