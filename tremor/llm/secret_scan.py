"""Secret scan with a recursive decoding worklist.

Three kinds of secrets are found in every layer of a text (fixed by the
task): ``assign``, a named value of 12 or more characters; ``access``, a key
id of 18 or more characters from AKIA on; ``hex``, a run of 16 or more hex
digits.  Per kind, matches are leftmost and do not overlap, and short ones
are dropped after matching.

The text is the first layer.  Each layer is unwrapped: percent escapes and
\\u, \\U, \\x escapes of the whole layer, and each base64 run (standard or
URL alphabet, also wrapped in lines of one width) whose bytes are text or, by
their signature, compressed text (gzip, zlib, bzip2, xz, zstandard, of one or
more members).  A run may hold more than the payload, as a path or a name
does: if it is not text as a whole, its parts of 16 characters or more that
are, at each of the four alignments, and compressed parts wherever a signature
stands are layers.  New layers join the worklist until none is left; a layer that was already seen over the
same place is not taken again, so cycles end.  Every layer's characters keep
the source range they come from (code points, end exclusive), which maps
their findings back; what comes out of a compressed run maps to the run.

Null text counts as empty and has no spans.  Equal findings count once.
A compressed run that would expand beyond MAX_EXPANDED bytes is left closed.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import slices

KINDS = ("assign", "access", "hex")     # fixed by the task, in this order
MAX_EXPANDED = 64 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ONE_UNICODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_MIN_RUN = 22                           # unpadded base64 of 16 bytes, the shortest finding
_BASE64 = re.compile(r"(?:(?:[A-Za-z0-9+/]{76}\r?\n)+|(?:[A-Za-z0-9+/]{64}\r?\n)+)[A-Za-z0-9+/]*={0,2}"
                     r"|[A-Za-z0-9+/_-]{%d,}={0,2}" % _MIN_RUN)

# runs on lines that follow each other
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# what _is_text takes, at least as long as the shortest finding
_TEXT_PART = re.compile(rb"(?:[\x09-\x0d\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
                        rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
                        rb"|\xf4[\x80-\x8f][\x80-\xbf]{2}){16,}+")
_SIGNATURE = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda\x20\x3f\x7d\xbb\xf9]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.S)

# byte classes for quick rejection: a run of n class bytes exists iff b"x" * n is in the translation
_HEX_CLASS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_B64_CLASS = bytes(120 if chr(c).isalnum() and c < 128 or chr(c) in "+/_-" else 32 for c in range(256))
_X16, _X22 = b"x" * 16, b"x" * _MIN_RUN
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def scan_layer(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the findings in one layer, in no order."""
    raw = text.encode("utf-8", "replace") if raw is None else raw
    found = []
    low = raw.lower()
    if any(n in low for n in _NAMES):
        found += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _X16 in raw.translate(_HEX_CLASS):
        found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """Decoded text and, per character, its source range (None: itself)."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text, self.start, self.end = text, start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source ranges of the layer's ranges [a, b)."""
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])

    def replaced(self, parts: list[tuple[int, int, str, list[int]]]) -> Layer:
        """The layer with each [a, b) replaced by characters; the last item
        holds how many of the layer's characters each of these comes from."""
        out, starts, ends, at = [], [], [], 0
        for a, b, text, widths in parts:
            keep = np.arange(at, a)
            cut = a + np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
            out += [self.text[at:a], text]
            starts += [keep, cut[:-1]]
            ends += [keep + 1, cut[1:]]
            at = b
        keep = np.arange(at, len(self.text))
        out.append(self.text[at:])
        a = np.concatenate([*starts, keep]).astype(np.int64)
        b = np.concatenate([*ends, keep + 1]).astype(np.int64)
        return Layer("".join(out), *self.ranges(a, b))


def _utf8(data: bytes) -> tuple[str, list[int]]:
    """Text of bytes and the bytes behind each character (invalid ones: U+FFFD, one each)."""
    try:
        text = data.decode()
        return text, [len(c.encode()) for c in text]
    except UnicodeDecodeError:
        out, widths, i = [], [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i:i + n].decode())
                    widths.append(n)
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                widths.append(1)
                i += 1
        return "".join(out), widths


def _unescape_percent(layer: Layer) -> Layer | None:
    parts = []
    for m in _PERCENT.finditer(layer.text):
        text, widths = _utf8(bytes.fromhex(m[0].replace("%", "")))
        parts.append((m.start(), m.end(), text, [3 * w for w in widths]))
    return layer.replaced(parts) if parts else None


def _unescape_unicode(layer: Layer) -> Layer | None:
    parts = []
    for m in _UNICODE.finditer(layer.text):
        codes, widths = [], []
        for one in _ONE_UNICODE.finditer(m[0]):
            code, width = int(one[1] or one[2] or one[3], 16), len(one[0])
            if codes and 0xD800 <= codes[-1] < 0xDC00 <= code < 0xE000:       # a surrogate pair
                codes[-1] = 0x10000 + (codes[-1] - 0xD800 << 10) + (code - 0xDC00)
                widths[-1] += width
            else:
                codes.append(code)
                widths.append(width)
        text = "".join(chr(c) if c < 0xD800 or 0xE000 <= c < 0x110000 else "�" for c in codes)
        parts.append((m.start(), m.end(), text, widths))
    return layer.replaced(parts) if parts else None


def _expand(data: bytes) -> tuple[bytes, int] | None:
    """Contents of a compressed byte string, all its members, and how many
    bytes they take; None if it is none (or too large)."""
    out, rest = [], data
    size = 0
    while True:
        try:
            if rest[:2] == b"\x1f\x8b":
                d = zlib.decompressobj(31)
            elif rest[:1] == b"\x78" and len(rest) > 1 and (rest[0] << 8 | rest[1]) % 31 == 0:
                d = zlib.decompressobj()
            elif rest[:3] == b"BZh":
                d = bz2.BZ2Decompressor()
            elif rest[:6] == b"\xfd7zXZ\x00":
                d = lzma.LZMADecompressor()
            elif rest[:4] == b"\x28\xb5\x2f\xfd":
                d = _Zstandard()
            else:
                break
            part = d.decompress(rest, MAX_EXPANDED + 1 - size)
        except Exception as e:      # damaged data of any of the libraries: not a layer
            if isinstance(e, MemoryError):
                raise
            break
        out.append(part)
        size += len(part)
        if size > MAX_EXPANDED:
            return None
        rest = d.unused_data if d.eof else b""
        rest = rest.lstrip(b"\0")                            # padding between members
    return (b"".join(out), len(data) - len(rest)) if out else None


class _Zstandard:
    """One zstandard frame, with the interface of the other decompressors."""

    def decompress(self, data: bytes, most: int) -> bytes:
        import zstandard
        found = zstandard.ZstdDecompressor().stream_reader(data).read(most)
        self.eof, self.unused_data = False, b""
        if len(found) < most:                                # bounded now, so the end of the frame can be sought
            d = zstandard.ZstdDecompressor().decompressobj()
            d.decompress(data)
            self.eof, self.unused_data = d.eof, d.unused_data
        return found


def _is_text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not re.search("[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Runs of the alphabet without line ends and padding, the places of their
    characters and one past the run's last."""
    for m in _BASE64.finditer(text):
        run = m[0]
        place = np.flatnonzero([c not in "\r\n" for c in run]) if "\n" in run else np.arange(len(run))
        body = "".join(run.split()) if "\n" in run else run
        yield body.rstrip("="), np.append(place[:len(body)], len(run)) + m.start()
    if "\n" not in text:
        return
    for block in _LINES.finditer(text):
        lines = [(m.start(), m.end()) for m in _LINE.finditer(text, *block.span())]
        width = [len(text[a:b].rstrip("=")) for a, b in lines]
        i = 0
        while i < len(lines) - 1:
            # lines of one width and a shorter one; other characters may stand before the first
            j, w = i + 1, width[i + 1]
            if width[i] < w:
                i = j
                continue
            while j < len(lines) and width[j] == w:
                j += 1
            last = j < len(lines) and width[j] < w
            end = j + last
            if sum(width[i:end]) >= _MIN_RUN:
                place = np.concatenate([np.arange(a, a + w) for (a, _), w in zip(lines[i:end], width[i:end])])
                yield "".join(text[a:a + w] for (a, _), w in zip(lines[i:end], width[i:end])), np.append(place, lines[end - 1][1])
            i = j


def _unpack_base64(layer: Layer) -> Iterator[Layer]:
    for body, place in _runs(layer.text):
        body = body.replace("-", "+").replace("_", "/")

        def decoded(text: str, skip: int, at: int) -> Layer:
            _, widths = _utf8(text.encode())
            ends = at + np.cumsum(widths)
            begins = ends - widths
            # bytes b..e-1 come from the characters b*8//6 .. (e*8-1)//6
            return Layer(text, *layer.ranges(place[skip + begins * 8 // 6], place[skip + (ends * 8 - 1) // 6] + 1))

        tried, whole = [], False
        for skip in range(4):            # what stands before may belong to the alphabet
            part = body[skip:]
            part = part[:len(part) - (len(part) % 4 == 1)]
            if len(part) < _MIN_RUN - 3:
                break
            try:
                data = base64.b64decode(part + "=" * (-len(part) % 4))
            except binascii.Error:
                continue
            text = _is_text(data)
            if text is not None:
                yield decoded(text, skip, 0)
                whole = True
                break
            tried.append((skip, data))
        for skip, data in tried if not whole else []:
            for m in _TEXT_PART.finditer(data):
                yield decoded(m[0].decode(), skip, m.start())
            past = 0
            for m in _SIGNATURE.finditer(data):
                if m.start() < past:
                    continue
                text, used = _opened(data[m.start():])
                if text is not None:
                    past = m.start() + used
                    a = int(place[skip + m.start() * 8 // 6])
                    b = int(place[skip + (past * 8 - 1) // 6]) + 1 if m.start() and past < len(data) else int(place[-1])
                    a, b = layer.source(a, b)
                    yield Layer(text, np.full(len(text), a), np.full(len(text), b))


def _opened(data: bytes) -> tuple[str | None, int]:
    """Text inside compressed bytes (which may be inside others), and how many
    bytes it takes; contents that come again end the search."""
    first, seen = 0, set()
    while (found := _expand(data)) is not None:
        data, used = found
        first = first or used
        text = _is_text(data)
        if text is not None:
            return text, first
        mark = hashlib.sha256(data).digest()
        if mark in seen:
            break
        seen.add(mark)
    return None, 0


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans of the text itself, all spans of all layers), sorted by
    start, kind and end, as (kind, start, end) in the text's code points."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    base = sorted(scan_layer(text, raw), key=lambda s: (s[1], s[0], s[2]))
    if not (b"%" in raw or b"\\" in raw or _X22 in raw.translate(_B64_CLASS, b"\r\n")):
        return base, base
    found = set(base)
    todo = [Layer(text)]
    seen = {(text, 0, len(text))}
    while todo:
        layer = todo.pop()
        new = [x for x in (_unescape_percent(layer), _unescape_unicode(layer)) if x is not None]
        new += _unpack_base64(layer)
        for x in new:
            if not x.text:
                continue
            mark = x.text, *x.source(0, len(x.text))
            if mark in seen:
                continue
            seen.add(mark)
            todo.append(x)
            found.update((k, *x.source(a, b)) for k, a, b in scan_layer(x.text))
    return base, sorted(found, key=lambda s: (s[1], s[0], s[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPAN_SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document row: counts and digest of the base spans, all spans.
    The counts are of base findings."""

    def run(batches):
        for batch in slices(batches):
            counts = np.zeros((batch.num_rows, 3), np.int64)
            digest, spans = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                base, every = find_secrets(t)
                for k, _, _ in base:
                    counts[i, k] += 1
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k].copy()) for k in range(3)), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPAN_SCHEMA)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every found span (overlapping ones together) replaced."""
    if text is None:
        return None
    out, at, end = [], 0, 0
    for _, a, b in find_secrets(text)[1]:
        if a >= end:
            out += [text[end:a], mark]
            end = b
        end = max(end, b)
    out.append(text[end:])
    return "".join(out)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with secrets in ``text`` replaced;
    ``n_chars``, where there is one, follows the new text."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            texts = pa.array([redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)],
                                             names=batch.schema.names)

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done
