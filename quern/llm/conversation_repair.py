"""Repair of conversations to the grammar `(s?(ua)+)?` of role initials by a forward Viterbi pass.

States are what has been given out last: nothing, a system turn, a user turn, an assistant turn. Each turn's layer
carries the least (cost, audit) of each state and is closed with the bounded insert transitions. Strings of one
state, layer and cost are never prefixes of each other, so the least string so far is that of the least whole.

Nothing gathers a whole conversation. Rows are dealt by ranges of (conversation, turn, role, text hash), so a long
one spreads over tasks. A run of rows that ends within its task is repaired there. One that may go on in
another, or is over HELD bytes, is carried as costs and audits from each of the four states, and its turns in
pieces of bounded size; those are put together in a second pass, which streams each conversation's pieces in
order. What that pass holds is an audit letter for a row and state, and one piece.

Defined cases: a null id of a conversation is one of its own; a null turn comes first; a null role or text counts as
one space, so such text is blank and such role must be changed; ties of turn are in order of role, then of a hash of
role and text; equal rows come one after the other, the first of them is no duplicate; conversations all of whose
rows are dropped have zeros and an empty audit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

GRAPH = r"[^\x20\x09-\x0D]"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after another turn given out in each state: a user turn, or after one an assistant turn.
FOLLOWING = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: BEYOND[x][y]: what it costs at most to go on from state x as one would from y.
BEYOND = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
LAWFUL = {"su", "ua", "au"}
OK, BLANK, TRUNCATED = 0, 1, 2
HELD = 1 << 22

ROWS = "conv_id long, turn long, role string, h binary, kind int, fault int, text string"
PIECES = """conv_id long, seg int, no int, n long, faults array<long>, span array<long>, ends array<string>,
    costs array<long>, audits array<string>, turns array<struct<role:string,text:string>>, total long, audit string, digest string"""


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (2 where a row is to be repeated, 0 where it is dropped) after damage by
    crc32(`conv_id:turn`) % 20."""
    c = conversations.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "coalesce(cast(role as string), ' ') as role", "coalesce(cast(text as string), ' ') as text")
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")])
    c = c.withColumn("d", F.crc32(name) % 20)
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """The rows to repair, each n times, with their faults; before them, under the same keys, marks of those whose role
    and text stand in an earlier turn; and one row for each conversation that has dropped rows."""
    h = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    fault = F.when(~F.col("text").rlike(GRAPH), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(OK)
    rows = rows.withColumn("h", h).withColumn("fault", fault)
    keys = rows.where(f"n > 0 and fault <> {BLANK}").select("conv_id", "role", "h", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at")).distinct()
    first = keys.groupBy(F.col("conv_id").alias("c"), F.col("h").alias("g")).agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    again = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g"))).where("at > first")
    nothing = lambda df, role, h, turn, kind: df.select("conv_id", turn.cast("long").alias("turn"), role.cast("string").alias("role"), h.cast("binary").alias("h"), F.lit(kind).alias("kind"), F.lit(0).alias("fault"), F.lit(None).cast("string").alias("text"))
    marks = nothing(again, F.col("role"), F.col("h"), F.col("at.turn"), 1)
    known = nothing(rows.where("n = 0").select("conv_id").distinct(), F.lit(None), F.lit(None), F.lit(None), 0)
    kept = rows.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select("conv_id", "turn", "role", "h", F.lit(2).alias("kind"), "fault", "text")
    return known.unionByName(marks).unionByName(kept)


class Best:
    """The least (cost, audit) of each state. What all audits begin with is kept once."""

    def __init__(self, costs: list[tuple[int, str] | None]):
        self.now, self.common, self.steps = costs, [], 0

    @classmethod
    def start(cls) -> Best:
        best = cls([(0, ""), None, None, None])
        best.now = cls.closed(best.now)
        return best

    @staticmethod
    def closed(layer):
        """With inserted turns: two at most, as a third leads to a state that one leads to."""
        for _ in range(2):
            more = list(layer)
            for x, got in enumerate(layer):
                if got is not None:
                    to, new = FOLLOWING[x], (got[0] + 2, got[1] + "I")
                    if more[to] is None or new < more[to]:
                        more[to] = new
            layer = more
        return layer

    def turn(self, initial: str, required: bool, truncated: bool) -> None:
        layer = [None] * 4

        def offer(state, cost, audit):
            if layer[state] is None or (cost, audit) < layer[state]:
                layer[state] = (cost, audit)

        for x, got in enumerate(self.now):
            if got is None:
                continue
            cost, audit = got
            offer(x, cost + 3, audit + "D")
            if not required:
                cost, to = cost + truncated, FOLLOWING[x]
                if initial == NAMES[to][0]:
                    offer(to, cost, audit + "K")
                elif initial == "s" and x == NOTHING:
                    offer(SYSTEM, cost, audit + "K")
                offer(to, cost + 2, audit + "R")
        layer = self.closed(layer)
        least = [min((got[0] + BEYOND[x][y] for x, got in enumerate(layer) if got is not None), default=0) for y in range(4)]
        self.now = [got if got is not None and got[0] <= least[y] else None for y, got in enumerate(layer)]
        self.steps += 1
        if self.steps % 16 == 0:
            shared = os.path.commonprefix([got[1] for got in self.now if got is not None])
            if shared:
                self.common.append(shared)
                self.now = [None if got is None else (got[0], got[1][len(shared) :]) for got in self.now]

    def whole(self) -> list[tuple[int, str] | None]:
        shared = "".join(self.common)
        return [None if got is None else (got[0], shared + got[1]) for got in self.now]


def replayed(turns, audit: str, state: int, place: int = 0) -> Iterator[tuple[int, int, tuple[str, str] | None]]:
    """(state, place in audit, turn given out or None) of the audit's letters from a place on; inserted turns after
    the last given turn belong to it."""
    for k, (role, text) in enumerate([*turns, (None, None)]):
        while place < len(audit) and audit[place] == "I":
            state, place = FOLLOWING[state], place + 1
            yield state, place, (NAMES[state], "")
        if k == len(turns):
            return
        letter, place = audit[place], place + 1
        if letter == "D":
            yield state, place, None
        elif letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield state, place, (role, text)
        else:
            state = FOLLOWING[state]
            yield state, place, (NAMES[state], text)


class Digest:
    """Turns given out as the digest of `role:text` lines."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, turn: tuple[str, str]) -> None:
        self.sha.update((("" if self.first else "\n") + f"{turn[0]}:{turn[1]}").encode())
        self.first = False

    def taken(self):
        return None

    def end(self):
        return [], self.sha.hexdigest()


class Turns:
    """Turns given out as they are, in pieces."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, turn: tuple[str, str]) -> None:
        self.held.append({"role": turn[0], "text": turn[1]})
        self.size += len(turn[1]) + 16

    def taken(self):
        if self.size < HELD:
            return None
        held, self.held, self.size = self.held, [], 0
        return held

    def end(self):
        return self.held, None


class Run:
    """Rows of one conversation in one task: counts, and costs from each state where the run is open."""

    def __init__(self, conv, seg: int, open_: bool):
        self.conv, self.seg, self.open, self.no = conv, seg, open_, 0
        self.rows, self.size, self.n = [], 0, 0
        self.faults, self.span, self.ends = [0, 0, 0, 0], None, None
        self.ways = None

    def add(self, turn, role: str, text: str, fault: int, again: bool) -> None:
        kind = 0 if fault == BLANK else 1 if again else 2 if fault == TRUNCATED else None
        if kind is not None:
            self.faults[kind] += 1
        initial = role[:1]
        if self.ends is None:
            self.ends = [initial, initial]
        else:
            self.faults[3] += self.ends[1] + initial not in LAWFUL
            self.ends[1] = initial
        if turn is not None:
            if self.span is None:
                self.span = [turn, turn, 1]
            elif turn != self.span[1]:
                self.span = [self.span[0], turn, self.span[2] + 1]
        self.n += 1
        self.rows.append((role, text, fault == BLANK or again, kind == 2))
        self.size += len(text) + 64

    def carried(self, last: bool) -> dict:
        """A piece of an open run; the last one has the counts, costs and audits."""
        if self.ways is None:
            self.ways = [Best([(0, "") if x == y else None for x in range(4)]) for y in range(4)]
        for role, _, required, truncated in self.rows:
            for way in self.ways:
                way.turn(role[:1], required, truncated)
        piece = {"conv_id": self.conv, "seg": self.seg, "no": self.no + 1, "turns": [{"role": r, "text": t} for r, t, _, _ in self.rows]}
        self.rows, self.size, self.no, self.open = [], 0, self.no + 1, True
        if last:
            ways = [way.whole() for way in self.ways]
            head = {"conv_id": self.conv, "seg": self.seg, "no": 0, "n": self.n, "faults": self.faults, "span": self.span, "ends": self.ends}
            head |= {"costs": [-1 if got is None else got[0] for way in ways for got in way], "audits": ["" if got is None else got[1] for way in ways for got in way]}
            return [piece, head]
        return [piece]

    def repaired(self, sink: Callable) -> list[dict]:
        """The whole of a run that nothing goes on from."""
        best = Best.start()
        for role, _, required, truncated in self.rows:
            best.turn(role[:1], required, truncated)
        cost, audit = min(got for x, got in enumerate(best.whole()) if x in (NOTHING, ASSISTANT) and got is not None)
        out, pieces = sink(), []
        for _, _, turn in replayed([r[:2] for r in self.rows], audit, NOTHING):
            if turn is not None:
                out.add(turn)
        turns, digest = out.end()
        pieces.append({"conv_id": self.conv, "seg": -1, "no": 0, "n": self.n, "faults": self.faults, "span": self.span, "turns": turns, "total": cost, "audit": audit, "digest": digest})
        return pieces


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _size(rows: list[dict]) -> int:
    return sum(sum(len(t["text"]) for t in r.get("turns") or ()) + sum(map(len, r.get("audits") or ())) for r in rows[-1:])


def _given(pieces: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += _size(held)
        if len(held) >= 1000 or size > HELD:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _rows(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, len(batch), at_once):
            yield from batch.slice(k, at_once).to_pylist()


def pieces(rows: DataFrame, sink: Callable) -> DataFrame:
    """Whole repaired conversations (seg -1) and pieces of those that may go on in another task."""
    schema = _schema(PIECES)

    def run(batches):
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId()

        def found():
            now, key, again = None, None, None
            for r in _rows(batches):
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        yield from now.carried(True) if now.open else now.repaired(sink)
                    now, key, again = Run(r["conv_id"], seg, now is None), None, None
                this = (r["turn"], r["role"], r["h"])
                if r["kind"] == 1:
                    again = this
                elif r["kind"] == 2:
                    now.add(r["turn"], r["role"], r["text"], r["fault"], this in (key, again))
                    key = this
                    if now.size > HELD:
                        yield from now.carried(False)
            if now is not None:
                yield from now.carried(True)

        yield from _given(found(), schema)

    dealt = rows.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h", "kind")
    return dealt.mapInArrow(frugal(run), PIECES)


def joined(parts: DataFrame, sink: Callable) -> DataFrame:
    """Pieces put together: per conversation its counts, cost and audit (no 0), and its turns in pieces (no 1 on)."""
    schema = _schema(PIECES)

    def chosen(heads: list[dict]):
        """(cost, audits by segment, counts, span, n) of a conversation's segments in order."""
        lead = Best.closed([(0, ""), None, None, None])
        best = [None if got is None else (got[0], got[1], (got[1],)) for got in lead]
        faults, span, last, n = [0, 0, 0, 0], None, None, 0
        for head in heads:
            faults, n = [a + b for a, b in zip(faults, head["faults"])], n + head["n"]
            if head["ends"]:
                faults[3] += last is not None and last + head["ends"][0] not in LAWFUL
                last = head["ends"][1]
            if head["span"]:
                a, b, m = head["span"]
                span = [a, b, m] if span is None else [span[0], b, span[2] + m - (span[1] == a)]
            following = [None] * 4
            for x, got in enumerate(best):
                for y in range(4):
                    cost = head["costs"][4 * x + y]
                    if got is not None and cost >= 0:
                        more = head["audits"][4 * x + y]
                        offer = (got[0] + cost, got[1] + more, (*got[2], more))
                        if following[y] is None or offer[:2] < following[y][:2]:
                            following[y] = offer
            best = following
        cost, audit, by_segment = min((got for x, got in enumerate(best) if x in (NOTHING, ASSISTANT) and got is not None), key=lambda got: got[:2])
        return {"total": cost, "audit": audit, "faults": faults, "span": span, "n": n}, by_segment

    def run(batches):
        def told():
            stream = _rows(batches, 16)
            r = next(stream, None)
            while r is not None:
                if r["seg"] < 0:
                    yield r
                    r = next(stream, None)
                    continue
                conv, heads = r["conv_id"], []
                while r is not None and r["conv_id"] == conv and r["no"] == 0:
                    heads.append(r)
                    r = next(stream, None)
                summary, audits = chosen(heads)
                out, no, state, at, place, name = sink(), 0, NOTHING, 0, 0, {"conv_id": conv, "seg": -1}
                for state, place, turn in replayed([], audits[0], state):
                    out.add(turn)
                place = 0
                while r is not None and r["conv_id"] == conv:
                    at, place = (at, place) if r["seg"] == heads[at]["seg"] else (next(k for k, head in enumerate(heads) if head["seg"] == r["seg"]), 0)
                    for state, place, turn in replayed([(t["role"], t["text"]) for t in r["turns"]], audits[at + 1], state, place):
                        if turn is not None:
                            out.add(turn)
                    if (turns := out.taken()) is not None:
                        no += 1
                        yield name | {"no": no, "turns": turns}
                    r = next(stream, None)
                turns, digest = out.end()
                if no and turns:
                    yield name | {"no": no + 1, "turns": turns}
                yield name | summary | {"no": 0, "turns": [] if no else turns, "digest": digest}

        yield from _given(told(), schema)

    # heads of all segments before the turns of any
    order = [F.col("conv_id"), F.col("no") > 0, F.col("seg"), F.col("no")]
    return parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(frugal(run), PIECES)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, no (pieces in order; most conversations have one) and turns (role, text) of repaired conversations.
    rows: conv_id, turn, role, text, n (how often the row stands; 0: it is gone), as damaged() gives them."""
    return joined(pieces(marked(rows), Turns), Turns).where("size(turns) > 0").select("conv_id", "no", "turns")


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. rows as above."""
    got = joined(pieces(marked(rows), Digest), Digest)
    gaps = F.coalesce(F.col("span")[1] - F.col("span")[0] + 1 - F.col("span")[2], F.lit(0))
    faults = [F.col("faults")[k].alias(c) for k, c in enumerate(("blank", "duplicate", "truncated", "illegal"))]
    return got.select("conv_id", gaps.cast("long").alias("gaps"), *faults, F.col("total").alias("cost"), "audit", F.col("digest").alias("repaired_sha256"))
