"""Conversation structure repair by integer-minimum dynamic programming.

A conversation's rows are edited until the initials of its roles read
``(s?(ua)+)?``: keep a row (no cost), give it the role user or assistant (3),
delete it (4; blank and duplicate rows must go) or insert an empty user or
assistant row anywhere (3); a truncated row that stays costs 3 more.  The
audit is the string of the edits' initials in order; of equally cheap repairs
the one with the ASCII-least audit is taken.

Cost and audit are one whole number: the high digits carry the cost, the low
ones (base 8, of a fixed width) the audit's letters from the most significant
place on (D 1, I 2, K 3, R 4), padded with zeros at the end.  So the smaller
number is the cheaper repair and among equally cheap ones the ASCII-least
audit, a shorter one before its continuations.  Rows and grammar states form
an acyclic graph; from its end, each node's number is the least of its edges'
numbers, an edge putting its letter before the audit that follows (its digit
at the front, the others one place down).  Nothing but integer minima decides.
The grammar leaves one role to each inserted or changed row, so the audit says
all of the repair.  A long conversation is solved in runs of RUN_ROWS rows,
each for every pair of states, and the runs are joined by the same minimum.

In Spark: rows are reduced to counted kinds (place, role's initial, faults)
without texts, duplicates found by a window over equal texts only, and read
in order as a stream, one number of a byte a row being held.  The repaired
texts are then read in order as a second stream that begins with each
conversation's audit; no text but the current one is held.

Rows are ordered by turn (nulls first), then role, then the SHA-256 of the
text; null roles and texts are one space.  A null conv_id is a conversation of
its own.  Rows alike in all columns are rows of their own, the later ones
duplicates.  ``gaps`` stays at 2^63 - 1 where it would be larger.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import slices

RUN_ROWS = 256                  # rows solved at once
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3                       # costs, fixed by the task
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = str.maketrans("1234", "DIKR")
_BITS = 3                       # of a digit

# Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.  From a state
# the initials that may follow, and where they lead; 0 and 3 may end.
_FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = ("u", "u", "a", "u")                  # the role of a row inserted or given a role in a state
_NEXT = (2, 2, 3, 2)                            # and the state after it
ROLE = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}                # fixed by the task

# A row as one number: 3 * initial (0 other, 1 s, 2 u, 3 a) + 0 sound, 1 truncated, 2 must go
INITIALS = " sua"


def _least(numbers):
    return min((n for n in numbers if n is not None), default=None)


def _solve_run(rows: bytes, ends: list[int | None], width: int, first: bool) -> list[int | None]:
    """Per state the least number of repairing the rows from there on, given
    the numbers after them.  Two insertions in a place are enough: three lead
    where one does."""
    front, mask = _BITS * (width - 1), (1 << _BITS * width) - 1

    def edge(cost: int, letter: str, after: int | None) -> int | None:
        if after is None:
            return None
        return (((after >> _BITS * width) + cost) << _BITS * width) | (_DIGIT[letter] << front) | ((after & mask) >> _BITS)

    def inserted(plain: list[int | None]) -> list[int | None]:
        once = [edge(INSERT, "I", plain[_NEXT[s]]) for s in range(4)]
        return [_least((plain[s], once[s], edge(INSERT, "I", once[_NEXT[s]]))) for s in range(4)]

    now = inserted(ends) if first else ends
    for row in reversed(rows):
        initial, fault = INITIALS[row // 3], row % 3
        plain = []
        for s in range(4):
            choices = [edge(DELETE, "D", now[s])]
            if fault < 2:
                choices.append(edge(REROLE + CUT * fault, "R", now[_NEXT[s]]))
                if initial in _FOLLOW[s]:
                    choices.append(edge(KEEP + CUT * fault, "K", now[_FOLLOW[s][initial]]))
            plain.append(_least(choices))
        now = inserted(plain)
    return now


def _digits(low: int, width: int) -> str:
    """The audit's digits without the padding."""
    return f"{low:0{width}o}".rstrip("0") if low else ""


def repair(rows: bytes, run_rows: int = RUN_ROWS) -> tuple[int, str]:
    """Cost and audit of the rows (numbers as above, in order)."""
    after = {0: (0, ""), 3: (0, "")}            # state: cost and digits of what follows
    starts = range(0, max(1, len(rows)), run_rows)
    for at in reversed(starts):
        run = rows[at:at + run_rows]
        last = at == starts[-1]
        width = 3 * len(run) + 2 + 1            # no audit of the run is longer: two insertions in each place
        best: list = [None] * 4
        for to, (cost, digits) in after.items():
            ends = [0 if s == to else None for s in range(4)]
            for s, number in enumerate(_solve_run(run, ends, width, last)):
                if number is not None:
                    whole = ((number >> _BITS * width) + cost, _digits(number & ((1 << _BITS * width) - 1), width) + digits)
                    best[s] = _join(best[s], whole)
        after = {s: b for s, b in enumerate(best) if b is not None}
    cost, digits = after[0]
    return cost, digits.translate(_LETTER)


def _join(one: tuple[int, str] | None, other: tuple[int, str]) -> tuple[int, str]:
    """The lesser of two numbers of one width, each given by cost and digits."""
    if one is None:
        return other
    width = max(len(one[1]), len(other[1]))
    return min(one, other, key=lambda x: (x[0] << _BITS * width) | int(x[1].ljust(width, "0") or "0", 8))


def illegal_pair(before: str, after: str) -> bool:
    return before + after not in LEGAL_PAIRS


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the task's damage, copies being
    how many rows (0, 1 or 2) a row has become."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                                F.coalesce(F.col("text").cast("string"), blank).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("what"))
    text = (F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).alias("copies"))


def kinds(rows: DataFrame) -> DataFrame:
    """Equal rows as one, without the text: conv_id, turn, role, mark (SHA-256
    of the text), copies, blank, cut, seen (an equal role and text is earlier)."""
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    slim = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"), "copies",
                       (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))
    runs = (slim.groupBy("conv_id", "turn", "role", "mark")
            .agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    # dropped rows come with all of their turn, so they are kinds of their own
    earlier = Window.partitionBy("conv_id", "role", "mark", F.col("copies") > 0).orderBy(F.col("turn").asc_nulls_first())
    return runs.withColumn("seen", F.row_number().over(earlier) > 1)


class _Summary:
    """What the rows of one conversation add up to, in order."""

    def __init__(self):
        self.rows = bytearray()
        self.least = self.most = self.previous = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, copies: int, blank: bool, cut: bool, seen: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.distinct += 1
        initial = role[:1]
        self.illegal += (self.previous is not None and illegal_pair(self.previous, initial)) + (copies - 1) * illegal_pair(initial, initial)
        self.previous = initial
        number = 3 * max(0, INITIALS.find(initial)) if initial else 0
        gone = copies if blank or seen else copies - 1          # copies after the first are duplicates
        if blank:
            self.blank += copies
        else:
            self.duplicate += gone
            if gone < copies:
                self.truncated += cut
                self.rows.append(number + cut)
        self.rows.extend(bytes([number + 2]) * gone)

    def result(self) -> tuple:
        cost, audit = repair(bytes(self.rows))
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def decisions(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each
    conversation, from damaged rows."""

    def run(batches):
        conv, summary = None, None
        for batch in batches:
            done = []
            for conv_id, turn, role, copies, blank, cut, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if summary is None or conv_id != conv:
                    if summary is not None:
                        done.append((conv, *summary.result()))
                    conv, summary = conv_id, _Summary()
                summary.add(turn, role, copies, blank, cut, seen)
            if done:
                yield _table(done)
        if summary is not None:
            yield _table([(conv, *summary.result())])

    def _table(done):
        kinds_of = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds_of)],
                                          names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark"]
    return (kinds(rows).repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "copies", "blank", "cut", "seen").mapInArrow(run, "conv_id bigint, " + _COUNTS))


class Writer:
    """Follows an audit over the rows of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._forced(), ""
            self.at += 1

    def _forced(self) -> str:
        role = ROLE[_FORCED[self.state]]
        self.state = _NEXT[self.state]
        return role

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows that the next row gives."""
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _FOLLOW[self.state][role[0]]
            yield role, text
        elif letter == "R":
            yield self._forced(), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def repaired_rows(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Damaged rows and each conversation's decisions as one sorted stream per
    conversation: conv_id, found (the decisions, on its first row only), role,
    text, copies."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    head = decided.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                          F.lit(None).cast("binary").alias("mark"), F.lit("").alias("text"), F.lit(1).alias("copies"),
                          F.struct(*names).alias("found"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role",
                                           F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"), "text", "copies",
                                           F.lit(None).cast(head.schema["found"].dataType).alias("found"))
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "mark"]
    return head.union(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "found", "role", "text", "copies")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every conversation, after the task's damage.

    repaired_sha256 is over the repaired rows as ``role:text``, joined by
    newlines, in UTF-8 (of nothing, if none is left)."""
    return digests(repaired_rows(damage(conversations), decisions(damage(conversations))))


def digests(stream: DataFrame) -> DataFrame:
    """The decisions and the hash of the repaired text of each conversation in the stream."""

    def run(batches):
        now = None                              # decisions, writer, hash, whether a row is in it

        def put(lines):
            for role, text in lines:
                if now[3]:
                    now[2].update(b"\n")
                now[3] = True
                now[2].update(role.encode("utf-8", "replace"))
                now[2].update(b":")
                now[2].update(text.encode("utf-8", "replace"))

        def closed():
            put(now[1].end())
            return (*now[0], now[2].hexdigest())

        for batch in batches:
            for part in slices([batch]):
                done = []
                for conv_id, found, role, text, copies in zip(*(c.to_pylist() for c in part.columns)):
                    if found is not None:
                        if now is not None:
                            done.append(closed())
                        now = [(conv_id, *found.values()), Writer(found["audit"]), hashlib.sha256(), False]
                        continue
                    for _ in range(copies):
                        put(now[1].rows(role, text))
                if done:
                    yield _rows(done)
        if now is not None:
            yield _rows([closed()])

    def _rows(done):
        kinds_of = [pa.int64()] * 7 + [pa.string()] * 2
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds_of)], names=names)

    return stream.mapInArrow(run, "conv_id bigint, " + _COUNTS + ", repaired_sha256 string")
