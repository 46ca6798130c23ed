"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

``build_lexicon`` counts pre-tokens over all documents (each task keeps its
most frequent ones, Spark sums them), takes the most frequent, computes
their ids and compiles them into a minimal acyclic automaton over bytes
whose arcs carry additive outputs: the sum along a word's path is its index
into the table of id sequences, so suffixes are shared although outputs
differ.  The arrays go into one file that Spark distributes with the job
(``SparkContext.addFile``) and each worker maps into memory.  Words outside
the lexicon are merged exactly, many at once, rank by rank.  The lexicon
only decides how ids are found, never which ids they are.

Texts are whole; null counts as empty.  The result equals the tokenizers
library on the same file, ``add_special_tokens=False``, the special tokens'
strings being recognised in texts as there.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import LOWER, SPACE, mix64, slices

DEFAULT_TOKENIZER = "word_bpe_49k.json"
LEXICON_WORDS = 50_000          # entries of the automaton
WORDS_PER_TASK = 20_000         # most frequent words that a task reports
COUNTER_LIMIT = 600_000         # entries of a task's counter before rare ones are dropped
CACHE_LIMIT = 300_000           # pieces whose ids an encoder remembers
SHORT_BYTES = 16                # pieces of so many bytes are looked up without Python objects
GROUP_CHARS = 1_000_000         # text encoded at once

# Unicode White_Space, which the file's patterns call \s
_WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPLIT_WHITE = re.compile(f"[{_WHITE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")         # white space for str.split only
# printable ASCII and precomposed Latin letters: NFC leaves them alone and they lower-case one by one
_PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]+")
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ž]+|[0-9]|\n|[^a-z\xdf-\xf6\xf8-ž0-9\n]+")
_MISSING = np.int64(1 << 40)
# kinds of bytes
_LETTER, _DIGIT, _OTHER, _HARD = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0, *range(0x80, 0xC3), *range(0xC4, 0x100)]] = _HARD
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of a public tokenizer file on this machine (a name or a full path)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_characters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The file's vocabulary and ranked merges as sorted arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        chars = _byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _MISSING) of each pair of ids, and the id it makes."""
        key = left << 20 | right
        hit = np.searchsorted(self.key, key)
        hit[hit == len(self.key)] = 0
        ok = self.key[hit] == key
        return np.where(ok, self.rank[hit], _MISSING), self.made[hit]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids of each word) of non-empty words.

        All words advance together: each round takes every word's pair of
        least rank, everywhere it occurs.  Pairs are looked up when they arise.
        """
        size = np.array([len(w) for w in words], np.int64)
        sym = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        sym[ends - 1] = self.final[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        last = np.zeros(len(sym), bool)               # a word's last symbol has no pair
        last[ends - 1] = True
        rank, made = np.full(len(sym), _MISSING), np.zeros(len(sym), np.int64)
        pairs = np.flatnonzero(~last)
        rank[pairs], made[pairs] = self.ranks(sym[pairs], sym[pairs + 1])
        at = np.arange(len(sym))                      # original places keep the order
        done_word, done_sym, done_at = [], [], []
        while len(sym):
            starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            lengths = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = best == _MISSING
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                done_at.append(at[over])
                live = ~over
                sym, word, at, last, rank, made, best = (x[live] for x in (sym, word, at, last, rank, made, best))
            # of overlapping places (one symbol repeated) every second is merged, from the left
            pos = np.flatnonzero(rank == best)
            if not len(pos):
                break
            run = np.concatenate([[True], np.diff(pos) > 1])
            nth = np.arange(len(pos)) - np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            pos = pos[nth % 2 == 0]
            sym[pos], last[pos] = made[pos], last[pos + 1]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            moved = pos - np.arange(len(pos))         # places after the right halves are gone
            sym, word, at, last, rank, made = (x[keep] for x in (sym, word, at, last, rank, made))
            touched = np.zeros(len(sym), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            rank[fresh] = _MISSING
            fresh = fresh[~last[fresh]]
            rank[fresh], made[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
        at, ids, word = (np.concatenate(x) for x in (done_at, done_sym, done_word))
        order = np.argsort(at, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """Minimal acyclic transducer of the words as one int32 array.

    Built incrementally from sorted words: once a branch can no longer
    change, its states are replaced by equal registered ones, so common
    suffixes are stored once.  An arc's output is the number of words that
    sort before those behind it.
    """
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]
    final, register, free = [False], {}, []

    def settle(path: list[tuple[int, int, int]], depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            signature = final[child], tuple(arcs[child].items())
            known = register.setdefault(signature, child)
            if known != child:
                arcs[parent][byte] = known
                arcs[child], final[child] = {}, False
                free.append(child)

    path: list[tuple[int, int, int]] = []
    before = b""
    for w in words:
        shared = len(os.path.commonprefix([before, w]))
        settle(path, shared)
        state = path[-1][2] if path else 0
        for byte in w[shared:]:
            if free:
                new = free.pop()
            else:
                new = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[state][byte] = new
            path.append((state, byte, new))
            state = new
        final[state] = True
        before = w
    settle(path, 0)
    live, stack = {0: 0}, [0]
    while stack:
        for child in arcs[stack.pop()].values():
            if child not in live:
                live[child] = len(live)
                stack.append(child)
    behind: dict[int, int] = {}

    def count(root: int) -> None:
        todo = [root]
        while todo:
            s = todo[-1]
            waiting = [c for c in arcs[s].values() if c not in behind]
            if waiting:
                todo.extend(waiting)
            else:
                behind[s] = final[s] + sum(behind[c] for c in arcs[s].values())
                todo.pop()

    count(0)
    rows = []
    for state, number in live.items():
        out = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            rows.append((number << 8 | byte, live[child], out))
            out += behind[child]
    rows.sort()
    table = np.array(rows, np.int32).reshape(-1, 3)
    ends = np.zeros(len(live), np.int32)
    for state, number in live.items():
        ends[number] = final[state]
    lengths = [len(entries[w]) for w in words]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    ids = np.array([i for w in words for i in entries[w]], np.int32)
    head = np.array([len(table), len(ends), len(words)], np.int32)
    return np.concatenate([head, table[:, 0], table[:, 1], table[:, 2], ends, offsets, ids]).astype(np.int32)


class Lexicon:
    """Read-only view of a compiled lexicon; walks many words at once."""

    def __init__(self, data: np.ndarray):
        arcs, states, words = (int(x) for x in data[:3])
        cut = np.cumsum([3, arcs, arcs, arcs, states, words + 1])
        self.key, self.target, self.out, self.ends, self.offset = (data[a:b] for a, b in zip(cut, cut[1:]))
        self.ids = data[cut[-1]:]

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, or -1."""
        if not len(self.key) or not words:
            return np.full(len(words), -1, np.int64)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        begin = np.cumsum(size) - size
        index = np.zeros(len(words), np.int64)
        state = np.zeros(len(words), np.int32)
        result = np.full(len(words), -1, np.int64)
        live = np.arange(len(words))
        step = 0
        while len(live):
            ended = size[live] == step
            stop = live[ended]
            good = stop[self.ends[state[stop]] > 0]
            result[good] = index[good]
            live = live[~ended]
            key = state[live] << 8 | flat[begin[live] + step]
            hit = np.searchsorted(self.key, key)
            hit[hit == len(self.key)] = 0
            ok = self.key[hit] == key
            live, hit = live[ok], hit[ok]
            state[live] = self.target[hit]
            index[live] += self.out[hit]
            step += 1
        return result


class WordTable:
    """Slots of words of at most SHORT_BYTES bytes, none of them zero.  A word is
    its own key, two 64-bit numbers, compared whole; many are looked up at once."""

    def __init__(self):
        self.key = np.zeros((2, 0), np.uint64)       # by slot; zero: no word of this table
        self.place = np.full(1 << 14, -1, np.int32)

    def _probe(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(key[0] + key[1] * _SPREAD) & np.uint64(len(self.place) - 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each word, or -1."""
        at = self._probe(key)
        found = self.place[at]
        live = np.flatnonzero(found >= 0)
        live = live[(self.key[:, found[live]] != key[:, live]).any(axis=0)]
        while len(live):                              # another word's place: the next one
            at[live] = (at[live] + 1) & (len(self.place) - 1)
            found[live] = self.place[at[live]]
            live = live[found[live] >= 0]
            live = live[(self.key[:, found[live]] != key[:, live]).any(axis=0)]
        return found

    def add(self, key: np.ndarray) -> None:
        """New slots, one after another: distinct words not yet here, or zeros."""
        slot = np.arange(self.key.shape[1], self.key.shape[1] + key.shape[1])
        self.key = np.concatenate([self.key, key], axis=1)
        if 2 * self.key.shape[1] > len(self.place):
            self.place = np.full(1 << (4 * self.key.shape[1]).bit_length(), -1, np.int32)
            slot = np.arange(self.key.shape[1])
        slot = slot[self.key[0, slot] > 0]
        at = self._probe(self.key[:, slot])
        while len(slot):
            free = self.place[at] < 0
            self.place[at[free]] = slot[free]
            lost = self.place[at] != slot
            slot, at = slot[lost], (at[lost] + 1) & (len(self.place) - 1)


def word_keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes begin[i]:begin[i]+size[i] of ``data`` as two numbers each;
    sizes of at most SHORT_BYTES, and as many bytes follow the last one."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return np.stack([eight[begin] & _FIRST_BYTES[np.minimum(size, 8)], eight[begin + 8] & _FIRST_BYTES[np.maximum(size, 8) - 8]])


def byte_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, begin, end, hard) of the pre-tokens of UTF-8 text
    that ends in white space.  ASCII and the letters of Latin-1 are told by
    their bytes.  A white-space-free chunk with anything else, or with ``<|``,
    is one hard piece, its bytes as they are."""
    kind, low = _KIND[data], LOWER[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        after = data[lead + 1]
        kind[lead + 1] = np.where((after == 0x97) | (after == 0xB7), _HARD, _LETTER)       # the signs of multiplication and division
        low[lead + 1] = after + np.where((after <= 0x9E) & (after != 0x97), 0x20, 0).astype(np.uint8)
    odd = np.concatenate([np.flatnonzero(kind == _HARD), np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))])
    if len(odd):
        space = np.flatnonzero(kind == 0)
        next_space = np.unique(np.searchsorted(space, odd))
        cover = np.zeros(len(data) + 1, np.int8)
        cover[np.where(next_space > 0, space[next_space - 1] + 1, 0)] = 1
        cover[space[next_space]] -= 1
        inside = np.cumsum(cover[:-1], dtype=np.int8) > 0
        kind[inside] = _HARD
        low[inside] = data[inside]
    edge = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == _DIGIT)
    mark = np.flatnonzero((data == 39) & (kind == _OTHER))
    mark = mark[(kind[mark - 1] != _OTHER) | (mark == 0)]
    if len(mark):                                     # 's 't 'm 'd 're 've 'll
        one, two = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        whole = long | (one == 115) | (one == 116) | (one == 109) | (one == 100)
        edge[mark[whole] + 1] = False
        edge[mark[whole] + 2 + long[whole]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(data))
    word = kind[at] > 0
    at, end = at[word], end[word]
    return low, at, end, kind[at] == _HARD


class Encoder:
    """Texts to ids.  Works on pieces of bytes (``byte_pieces``) and remembers
    their ids; chunks that bytes do not tell apart go by their characters."""

    def __init__(self, path: str, lexicon: np.ndarray | None = None):
        self.path = path
        self.merges = Merges(path)
        self.lexicon = Lexicon(lexicon) if lexicon is not None else None
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")") \
            if self.merges.special else None
        self._library = None
        self._forget()

    def _forget(self) -> None:
        self.short = WordTable()              # its slots are those of begin and size
        self.long: dict[bytes, int] = {}      # slots of longer pieces and of hard chunks
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.buffer = np.zeros(0, np.uint16)

    def chunks(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return [c for c in _SPLIT_WHITE.split(text) if c]
        return text.split()

    def pretokens(self, chunk: str) -> list[bytes | int]:
        """Byte strings to merge, and ids of special tokens, of one chunk."""
        if self.specials and "<|" in chunk and self.specials.search(chunk):
            parts: list[bytes | int] = []
            for part in self.specials.split(chunk):
                if part in self.merges.special:
                    parts.append(self.merges.special[part])
                elif part:
                    parts += self.pretokens(part)
            return parts
        if _PLAIN.fullmatch(chunk):
            return [p.encode() for p in _PLAIN_PIECES.findall(chunk.lower())]
        if self._library is None:      # other scripts: the file's own normaliser and splitter
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        own, byte_of = self._library, self.merges.byte_of
        return [bytes(byte_of[c] for c in p)
                for p, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(chunk))]

    def _learn(self, plain: list[bytes], hard: list[bytes]) -> None:
        """Slots for new pieces and, after them, for new hard chunks."""
        word_slot = {w: n for n, w in enumerate(plain)}
        flat: list[int] = []                  # word number, or -1 - id
        more = []
        for chunk in hard:
            found = [p for c in self.chunks(chunk.decode()) for p in self.pretokens(c)]
            more.append(len(found))
            for p in found:
                flat.append(-1 - p if isinstance(p, int) else word_slot.setdefault(p, len(word_slot)))
        counts = np.concatenate([np.ones(len(plain), np.int64), np.array(more, np.int64)])
        ids, sizes = self._words(list(word_slot))
        begins = np.cumsum(sizes) - sizes
        part = np.concatenate([np.arange(len(plain)), np.array(flat, np.int64)])
        word = part >= 0
        extra = -1 - part[~word]              # special ids follow the words' ids
        source = np.concatenate([ids, extra])
        p_begin, p_size = np.empty(len(part), np.int64), np.ones(len(part), np.int64)
        p_begin[word], p_size[word] = begins[part[word]], sizes[part[word]]
        p_begin[~word] = len(ids) + np.arange(len(extra))
        gathered = ragged(source, p_begin, p_size)
        bounds = np.concatenate([[0], np.cumsum(p_size)])[np.concatenate([[0], np.cumsum(counts)])]
        size = np.array([len(w) for w in plain], np.int64)
        few = size <= SHORT_BYTES
        self.long.update((w, len(self.size) + n) for n, w in enumerate(plain + hard) if n >= len(plain) or not few[n])
        key = np.zeros((2, len(plain) + len(hard)), np.uint64)
        key[:, :len(plain)][:, few] = word_keys(np.frombuffer(b"".join(plain) + bytes(SHORT_BYTES), np.uint8), (np.cumsum(size) - size)[few], size[few])
        self.short.add(key)
        self.begin = np.concatenate([self.begin, len(self.buffer) + bounds[:-1]])
        self.size = np.concatenate([self.size, np.diff(bounds)])
        self.buffer = np.concatenate([self.buffer, gathered.astype(np.uint16)])

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.lexicon is None:
            return self.merges.merge(words)
        found = self.lexicon.lookup(words)
        lost = np.flatnonzero(found < 0)
        more, more_size = self.merges.merge([words[i] for i in lost]) if len(lost) else (np.zeros(0, np.int64),) * 2
        offset = self.lexicon.offset.astype(np.int64)
        begin = np.where(found >= 0, offset[found], 0)
        size = np.where(found >= 0, offset[found + 1] - offset[found], 0)
        begin[lost] = len(self.lexicon.ids) + np.cumsum(more_size) - more_size
        size[lost] = more_size
        return ragged(np.concatenate([self.lexicon.ids, more]), begin, size), size

    def forget(self) -> None:
        """Give the remembered chunks up; a task does so at its end, since
        worker processes outlive it."""
        self._forget()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint16 ids of each text, in order."""
        group: list[str] = []
        chars = 0
        for t in texts:
            group.append(t or "")
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.size) > CACHE_LIMIT:
            self._forget()
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join([*raw, bytes([10]) * SHORT_BYTES]), np.uint8)
        low, begin, end, hard = byte_pieces(data)
        size = end - begin
        slot = np.full(len(begin), -1, np.int64)
        few = np.flatnonzero((size <= SHORT_BYTES) & ~hard)
        slot[few] = self.short.find(word_keys(low, begin[few], size[few]))
        lost = np.flatnonzero(slot < 0)
        joined = low.tobytes()
        words = [joined[a:b] for a, b in zip(begin[lost].tolist(), end[lost].tolist())]
        slot[lost] = np.fromiter(map(self.long.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = [(w, h) for w, s, h in zip(words, slot[lost].tolist(), hard[lost].tolist()) if s < 0]
        if new:
            plain, tough = (list(dict.fromkeys(w for w, h in new if h == kind)) for kind in (False, True))
            number = {w: n for n, w in enumerate(plain + tough, len(self.size))}
            self._learn(plain, tough)
            slot[lost[slot[lost] < 0]] = [number[w] for w, _ in new]
        size = self.size[slot]
        ids = ragged(self.buffer, self.begin[slot], size)
        first = np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in raw]))
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b]


def ragged(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """source[begin[0]:begin[0]+size[0]], source[begin[1]:...], ... joined."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return source[:0]
    return source[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]


_encoders: dict[tuple, Encoder] = {}


def worker_encoder(tokenizer: str, lexicon_file: str | None = None) -> Encoder:
    """This Python worker's encoder; the lexicon file is mapped, not read."""
    key = tokenizer, lexicon_file
    if key not in _encoders:
        _encoders.clear()
        data = np.load(SparkFiles.get(lexicon_file), mmap_mode="r") if lexicon_file else None
        _encoders[key] = Encoder(tokenizer_path(tokenizer), data)
    return _encoders[key]


def count_pretokens(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(word binary, n) of the most frequent pre-tokens of all documents.
    Each task counts its own rows; rare words are dropped from a counter that
    grows too large, so counts are lower bounds.  They rank the lexicon only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer)
        seen: Counter = Counter()
        floor = 1
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(enc.chunks(t))
                    if len(seen) > COUNTER_LIMIT:
                        seen = Counter({w: n for w, n in seen.items() if n > floor})
                        floor += 1
        words: Counter = Counter()
        for chunk, n in seen.most_common(2 * WORDS_PER_TASK):
            for p in enc.pretokens(chunk):
                if isinstance(p, bytes) and len(p) <= 64:
                    words[p] += n
        top = words.most_common(WORDS_PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()),
                                          pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return (docs.select("text").mapInArrow(count, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, words: int = LEXICON_WORDS) -> str:
    """Compile the corpus's most frequent words and ship the file with the
    job; returns its name for ``SparkFiles.get``.  Size: ``words`` entries."""
    top = count_pretokens(docs, tokenizer).orderBy(F.desc("n"), "word").limit(words).collect()
    entries = [bytes(r.word) for r in top]
    ids, size = Encoder(tokenizer_path(tokenizer))._words(entries)
    cut = np.concatenate([[0], np.cumsum(size)]).astype(int)
    data = compile_lexicon({w: ids[a:b].tolist() for w, a, b in zip(entries, cut, cut[1:])})
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    place = os.path.join(tempfile.mkdtemp(prefix="tremor-lexicon-"), name)
    np.save(place, data)
    docs.sparkSession.sparkContext.addFile(place)
    return name


def encode_documents(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, lexicon_file: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: whole texts encoded."""

    def run(batches):
        enc = worker_encoder(tokenizer, lexicon_file)
        for batch in slices(batches):
            ids = [x.astype(np.int32) for x in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])
        enc.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def _joiner(enc: Encoder) -> Callable[[list[int]], bytes]:
    """Decoding as the library does without a decoder: tokens joined by blanks,
    unknown ids left out."""
    size = max(enc.merges.token) + 1
    piece: list[bytes | None] = [None] * size
    for i, t in enc.merges.token.items():
        piece[i] = t.encode()
    if None not in piece:
        return lambda ids: b" ".join(map(piece.__getitem__, ids))
    return lambda ids: b" ".join(p for p in (piece[i] if 0 <= i < size else None for i in ids) if p is not None)


def decode_documents(encoded: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, text: the ids of each row decoded (null ids: empty text)."""

    def run(batches):
        join = _joiner(worker_encoder(tokenizer))
        for batch in slices(batches):
            texts = [join(x or []).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, lexicon_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; repeated rows
    stay, a null doc_id is kept, null text counts as empty."""

    def run(batches):
        enc = worker_encoder(tokenizer, lexicon_file)
        join = _joiner(enc)
        for batch in slices(batches):
            n, a, b = [], [], []
            for ids in enc.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(join(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    return round_trip_digests(docs, tokenizer, build_lexicon(docs, tokenizer))
