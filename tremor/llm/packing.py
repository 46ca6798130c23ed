"""Lexical retrieval packing of documents into token sequences.

Documents are tokenised where they lie (ids, then the end id).  Windows that
a document fills alone become sequences at once; its remainder goes to a
shard, where a BM25 inverted index over token ids returns, for each seed, the
unused neighbours in order of score.  They fill the seed's window greedily;
the one that does not fit is cut, and its rest seeds the next window.  Without
neighbours that share a term, the next unused document follows.  What is left
at a shard's end is cut into sequences whose lengths are powers of two, so no
sequence needs padding.

N, document frequencies and the mean length are counted over all remainders.
Shards are chosen by content: each remainder's vector of BM25 weights is
projected to COORDINATES directions (the main ones of a sample), and a tree
that halves the coordinates along their direction of largest spread deals
them to shards of about SHARD_DOCS.  Its upper levels are laid by a sample, at
most ROUTES leaves; a task splits its leaf further by the rows themselves.  A
leaf that gets more than twice its share (many copies) is dealt to several
tasks by a hash.  A seed searches its own shard alone: neighbours whose
contents differ in the main directions can still be parted (README has the
measured share).

Results carry pieces, not ids: each id of each row lies in exactly one
piece.  Null and empty texts have the end id alone; repeated rows are packed
as often as they occur; a null doc_id is kept and dealt by its text.
Equal scores go by place in the shard, which is sorted by doc_id and text
hash, so the result does not depend on partitioning.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import bpe
from tremor.llm.common import mix64, reliable, slices

WINDOW = 4096
END_ID = 2                      # fixed by the task
SHARD_DOCS = 512                # expected remainders in a shard
COORDINATES = 16                # directions by which shards are told apart
BASIS_DOCS = 2048               # sampled remainders that give the directions
ROUTES, ROUTE_DOCS = 4096, 64   # leaves laid by a sample at most, sampled rows of each
K1, B = 1.2, 0.75               # BM25

PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint")
_NAMES = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
_TAIL_SCHEMA = "doc_id bigint, mark bigint, doc_tokens bigint, full binary, tail binary"
_TAIL_NAMES = [c.split()[0] for c in _TAIL_SCHEMA.split(", ")]
_TERMS = 1 << 16                # token ids are 16 bits wide


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """One row per document: checksums of its full windows and its remainder."""

    def run(batches):
        enc = bpe.worker_encoder(tokenizer)
        for batch in slices(batches):
            full, tail, size = [], [], []
            for ids in enc.encode(batch.column(2).to_pylist()):
                ids = np.append(ids, np.uint16(END_ID))
                n = len(ids) // window
                full.append(np.array([_crc(ids[k * window:(k + 1) * window]) for k in range(n)], "<u4").tobytes())
                tail.append(ids[n * window:].astype("<u2").tobytes())
                size.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()),
                 pa.array(full, pa.binary()), pa.array(tail, pa.binary())],
                names=["doc_id", "mark", "doc_tokens", "full", "tail"])
        enc.forget()

    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
            .mapInArrow(run, _TAIL_SCHEMA))


@dataclass
class Corpus:
    """What BM25 needs to know of all remainders: how many there are, their
    mean length, and in how many each term occurs."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def term_counts(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the distinct terms by document and
    term, and the documents' lengths."""
    size = np.array([len(t) for t in tails], np.int64)
    key = np.repeat(np.arange(len(tails)), size) * _TERMS + np.concatenate([*tails, np.zeros(0, np.uint16)]).astype(np.int64)
    key.sort()
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    doc, term = np.divmod(key[edge], _TERMS)
    return doc, term, np.diff(np.append(edge, len(key))).astype(np.float64), size


def _tails(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u2") for t in column.to_pylist()]


def corpus_counts(tokens: DataFrame) -> Corpus:
    """Counted over all rows of ``tokenise``; one row a term reaches the driver."""

    def run(batches):
        count = np.zeros(_TERMS + 2, np.int64)              # after the terms: documents, ids
        for batch in slices(batches):
            _, term, _, size = term_counts(_tails(batch.column(0)))
            count[:_TERMS] += np.bincount(term, minlength=_TERMS)
            count[_TERMS:] += np.count_nonzero(size), size.sum()
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["term", "df"])

    count = np.zeros(_TERMS + 2, np.int64)
    for r in tokens.select("tail").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        count[r.term] = r.df
    n, ids = count[_TERMS:].tolist()
    return Corpus(n, ids / max(1, n), count[:_TERMS])


def weights(tails: list[np.ndarray], corpus: Corpus, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, BM25 weight over the document's Euclidean length)."""
    doc, term, tf, size = term_counts(tails)
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(1.0, corpus.mean)))
    return doc, term, weight / np.sqrt(np.bincount(doc, weight * weight, minlength=len(tails)))[doc]


def directions(tails: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Main directions of the sampled remainders, a row per term."""
    doc, term, weight = weights(tails, corpus, corpus.idf())
    known, column, found = np.unique(term, return_inverse=True, return_counts=True)
    if (found > 1).any():                                   # what one document alone has tells nothing of others
        kept = np.flatnonzero((found > 1)[column])
        doc, term, weight = doc[kept], term[kept], weight[kept]
        known, column = np.unique(term, return_inverse=True)
    x = np.zeros((len(tails), len(known)), np.float32)
    x[doc, column] = weight
    _, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
    main = x.T @ vectors[:, -COORDINATES:]
    main /= np.maximum(1e-9, np.linalg.norm(main, axis=0))
    out = np.zeros((_TERMS, main.shape[1]), np.float32)
    out[known] = main
    return out


def coordinates(tails: list[np.ndarray], corpus: Corpus, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    doc, term, weight = weights(tails, corpus, idf)
    out = np.zeros((len(tails), basis.shape[1]), np.float32)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        out[doc[first]] = np.add.reduceat(basis[term] * weight[:, None], first, axis=0)
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direction of largest spread and the rows in order along it."""
    c = x - x.mean(axis=0)
    way = np.linalg.eigh(c.T.astype(np.float64) @ c)[1][:, -1].astype(np.float32)
    return way, np.argsort((x * way).sum(axis=1), kind="stable")


def split_rows(x: np.ndarray, most: float) -> list[np.ndarray]:
    """Runs of at most ``most`` rows (places in ascending order) that lie together."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(np.sort(rows))
            continue
        order = rows[halves(x[rows])[1]]
        todo += [order[len(rows) // 2:], order[:len(rows) // 2]]
    return out


class Router:
    """Tree over coordinates, laid by a sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.way, self.cut, self.child, self.leaves = [], [], [], 0
        self._lay(sample, leaves)
        self.way = np.array(self.way, np.float32).reshape(len(self.cut), sample.shape[1])
        self.cut, self.child = np.array(self.cut, np.float32), np.array(self.child, np.int64).reshape(-1, 2)

    def _lay(self, x: np.ndarray, leaves: int) -> int:
        """The node's number; a leaf's is -1 - leaf."""
        if leaves > 1 and len(x) > 1:
            way, order = halves(x)
            at = (x[order] * way).sum(axis=1)
            middle = len(x) * (leaves // 2) // leaves
            if at[0] < at[-1]:
                cut = at[middle] if at[middle] > at[0] else at[np.argmax(at > at[0])]
                node = len(self.cut)
                self.way.append(way)
                self.cut.append(cut)
                self.child.append(None)
                below = at < cut
                self.child[node] = (self._lay(x[order[below]], leaves // 2), self._lay(x[order[~below]], leaves - leaves // 2))
                return node
        self.leaves += 1
        return -self.leaves

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.cut) else -1, np.int64)
        while (live := np.flatnonzero(node >= 0)).size:
            at = node[live]
            node[live] = self.child[at, ((x[live] * self.way[at]).sum(axis=1) >= self.cut[at]).astype(int)]
        return -1 - node


def deal(tokens: DataFrame, corpus: Corpus, shard_docs: int) -> DataFrame:
    """Rows of ``tokenise`` with their coordinates (``at``) and the task that
    splits and packs them (``part``)."""
    rows = tokens.count()
    leaves = min(ROUTES, math.ceil(rows / shard_docs))
    if leaves < 2:
        return tokens.withColumn("at", F.lit(b"")).withColumn("part", F.lit(0).cast("bigint"))
    spread = F.xxhash64("doc_id", "mark")
    # rows are drawn by their hash, so a task sends its share of the sample and no more; copies of a row once
    few = F.pmod(F.xxhash64(spread, F.lit(1)), F.lit(max(1, rows // (2 * BASIS_DOCS)))) == 0
    sampled = sorted((r.spread, bytes(r.tail)) for r in tokens.where(F.length("tail") > 0).select(spread.alias("spread"), "tail").where(few).distinct().collect())
    basis = directions([np.frombuffer(tail, "<u2") for _, tail in sampled[:BASIS_DOCS]], corpus)
    idf = corpus.idf()

    def points(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, basis.shape[1])

    # coordinates are computed where they are needed: a second table of all tokens would cost
    # more; and by the task's one worker, since each step of its own would be another process
    def place(batch: pa.RecordBatch) -> np.ndarray:
        return coordinates(_tails(batch.column("tail")), corpus, idf, basis)

    def bytes_of(x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in x], pa.binary())

    def locate(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("spread"), bytes_of(place(batch))], names=["spread", "at"])

    one_in = max(1, rows // (leaves * ROUTE_DOCS))
    chosen = (tokens.where(F.pmod(F.xxhash64(spread), F.lit(one_in)) == 0).select(spread.alias("spread"), "tail")
              .mapInArrow(locate, "spread bigint, at binary").distinct().collect())
    router = Router(points(pa.array([p for _, p in sorted((r.spread, bytes(r.at)) for r in chosen)], pa.binary())), leaves)

    def count(batches):
        found = np.zeros(router.leaves, np.int64)
        for batch in slices(batches):
            found += np.bincount(router.leaf(place(batch)), minlength=router.leaves)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(router.leaves)), pa.array(found)], names=["leaf", "rows"])

    # a leaf has as many parts as it has shares, if it has more than two
    counts = np.zeros(router.leaves, np.int64)
    for r in tokens.select("tail").mapInArrow(count, "leaf bigint, rows bigint").groupBy("leaf").agg(F.sum("rows").alias("rows")).collect():
        counts[r.leaf] = r.rows
    share = max(shard_docs, rows / leaves)
    parts = np.where(counts > 2 * share, np.ceil(counts / share), 1).astype(np.int64)
    first = np.cumsum(parts) - parts

    def route(batches):
        for batch in slices(batches):
            x = place(batch)
            leaf = router.leaf(x)
            part = first[leaf].astype(np.uint64) + mix64(batch.column("spread").to_numpy().view(np.uint64)) % parts[leaf].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bytes_of(x), pa.array(part.astype(np.int64))], names=[*_TAIL_NAMES, "at", "part"])

    return tokens.withColumn("spread", spread).mapInArrow(route, f"{_TAIL_SCHEMA}, at binary, part bigint")


class ShardIndex:
    """BM25 over the remainders of one shard; terms are token ids.  Without
    ``corpus`` the shard's own remainders are all there are."""

    def __init__(self, tails: list[np.ndarray], corpus: Corpus | None = None):
        n = len(tails)
        size = np.array([len(t) for t in tails], np.int64)
        key = np.concatenate(tails).astype(np.int64) * n + np.repeat(np.arange(n), size)
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(edge, len(key))).astype(np.float64)
        term, self.doc = np.divmod(key[edge], n)
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        self.begin = starts
        self.df = np.diff(np.append(starts, len(term)))
        if corpus is None:
            idf, mean = Corpus(n, size.mean(), self.df).idf(), size.mean()
        else:
            idf, mean = Corpus(corpus.n, corpus.mean, corpus.df[term[starts]]).idf(), corpus.mean
        norm = K1 * (1 - B + B * size / max(1.0, mean))
        self.weight = np.repeat(idf, self.df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # each document's terms, as places in the inverted index
        slot = np.repeat(np.arange(len(starts)), self.df)
        order = np.argsort(self.doc, kind="stable")
        self.terms = slot[order]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct terms."""
        terms = self.terms[self.bounds[seed]:self.bounds[seed + 1]]
        terms = terms[self.df[terms] > 1]
        at = bpe.ragged(np.arange(len(self.doc)), self.begin[terms], self.df[terms])
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def pack_shard(shard: int, rows: list[tuple], window: int, corpus: Corpus | None = None, number: int = 0) -> Iterator[tuple]:
    """Pieces of one shard's documents, sequences from ``number`` on.  rows:
    (doc_id, doc_tokens, full, tail)."""
    number += shard << 32

    for doc_id, size, full, _ in rows:
        for k, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
            yield doc_id, k * window, window, crc, size, number, 0
            number += 1

    live = [(d, s, np.frombuffer(t, "<u2")) for d, s, _, t in rows if t]
    if not live:
        return
    index = ShardIndex([t for _, _, t in live], corpus)
    unused = np.ones(len(live), bool)
    following = 0

    def seeds() -> int:
        nonlocal following
        while following < len(live) and not unused[following]:
            following += 1
        return following if following < len(live) else -1

    def piece(i: int, a: int, b: int, sequence: int, offset: int) -> tuple:
        d, s, t = live[i]
        return d, s - len(t) + a, b - a, _crc(t[a:b]), s, sequence, offset

    rest: tuple[int, int] | None = None               # document and how much of it is packed
    while True:
        if rest is None:
            first = seeds()
            if first < 0:
                return
            unused[first] = False
            rest = first, 0
        seed, a = rest
        parts = [(seed, a, len(live[seed][2]))]
        used = parts[0][2] - a
        rest = None
        ranked: list[int] = []
        if unused.any():
            score = np.where(unused, index.scores(seed), 0.0)
            near = np.argsort(-score, kind="stable")
            ranked = near[:np.count_nonzero(score > 0)].tolist()
        place = 0
        while used < window:
            while place < len(ranked) and not unused[ranked[place]]:
                place += 1
            j = ranked[place] if place < len(ranked) else seeds()
            if j < 0:
                break
            unused[j] = False
            room = window - used
            size = len(live[j][2])
            parts.append((j, 0, min(size, room)))
            used += min(size, room)
            if size > room:
                rest = j, room
        if used == window:
            at = 0
            for i, x, y in parts:
                yield piece(i, x, y, number, at)
                at += y - x
            number += 1
        else:                                          # the shard's end: powers of two
            for i, x, y, sequence, at in split_by_powers(parts, used):
                yield piece(i, x, y, number + sequence, at)
            return


def split_by_powers(parts: list[tuple[int, int, int]], used: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Cut parts of ``used`` ids together into runs of 2**k ids, largest first."""
    sizes = [1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1]
    sequence, at = 0, 0
    for i, x, y in parts:
        while x < y:
            if at == sizes[sequence]:
                sequence, at = sequence + 1, 0
            n = min(y - x, sizes[sequence] - at)
            yield i, x, x + n, sequence, at
            x, at = x + n, at + n


def pack_documents(docs: DataFrame, tokenizer: str = bpe.DEFAULT_TOKENIZER, window: int = WINDOW,
                   shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pieces of all documents, by sequence.  The number of shards grows with
    the number of documents; a task holds one leaf's remainders (less than
    ``window`` ids each) at a time and packs them a shard after another."""
    tokens = reliable(tokenise(docs, tokenizer, window))
    corpus = corpus_counts(tokens)

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "full", "tail"))))
        part, found = key[0].as_py(), []
        # a leaf up to half as large again is one shard
        for places in split_rows(np.frombuffer(b"".join(table.column("at").to_pylist()), "<f4").reshape(len(rows), -1), 1.5 * shard_docs):
            number = found[-1][5] + 1 - (part << 32) if found else 0
            found += pack_shard(part, [rows[i] for i in places], window, corpus, number)
        columns = list(zip(*found)) or [()] * len(_NAMES)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

    return deal(tokens, corpus, shard_docs).groupBy("part").applyInArrow(run, PIECE_SCHEMA)
