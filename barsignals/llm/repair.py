"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, last role kept); edges are the edits: Keep (free),
Rerole to user or assistant (2), Delete (3, the only way past a blank or repeated row),
Insert an empty user or assistant row (2); a truncated row that stays costs 1 more. The
role an edit writes follows from the last role, so the edits' initials (the audit) tell
the repair. A forward and a reverse heap grow towards each other until their tops sum
to more than the best crossing; of all crossings of that cost the least concatenated
audit wins. No audit of a node is a prefix of another of the same cost (it would have to
go on with Inserts, which cost), so the least parts make the least whole.

A conversation is read in turn order by one task, as its digest must be, but as a
stream: it is cut into blocks of rows, each block is searched from every role that the
last one can end with, and a running digest is kept for each. A task holds one block,
and four audits, of the conversation it reads, however long that is.

NULLs read as one space: in the text (then blank), in the role (then illegal), and in
the id or turn where these name a row. Rows without an id are one conversation; rows
without a turn come first. Rows of one turn stand in the order of their role, then
their text. A role's initial is its first character; an empty role has none and can't be
kept. A conversation whose rows are all dropped gives zeros. An empty table gives no
rows; extra columns are not read; repeated rows are rows (the later ones duplicates).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsignals.llm.common import per_batch

START, SYSTEM, USER, ASSISTANT = range(4)
# role state after a kept row of this initial; a state's next written role
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 512


@dataclass(frozen=True)
class Row:
    """What the lattice needs of a row: its role's initial, whether it must go, whether it is truncated."""
    initial: str
    must_go: bool
    cut: bool


def _after(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges out of a node: (cost, initial of the edit, rows read, state)."""
    if i < len(rows):
        r = rows[i]
        yield DELETE, "D", i + 1, state
        if not r.must_go:
            kept = KEEP.get((state, r.initial))
            if kept is not None:
                yield r.cut * TRUNCATED, "K", i + 1, kept
            yield REROLE + r.cut * TRUNCATED, "R", i + 1, NEXT[state]
    yield INSERT, "I", i, NEXT[state]


def _before(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Edges into a node: (cost, initial of the edit, rows read, state)."""
    if i:
        r = rows[i - 1]
        yield DELETE, "D", i - 1, state
        if not r.must_go:
            for (source, initial), target in KEEP.items():
                if target == state and initial == r.initial:
                    yield r.cut * TRUNCATED, "K", i - 1, source
    for source, target in NEXT.items():
        if target == state:
            if i and not rows[i - 1].must_go:
                yield REROLE + rows[i - 1].cut * TRUNCATED, "R", i - 1, source
            yield INSERT, "I", i, source


class _Side:
    """One heap: least cost of each node, and the least audit among those of that cost.

    Only edges that read a row are free, so of equal costs the nodes nearer to this
    side's origin settle first, and an audit is final when its node settles.
    """

    def __init__(self, sources: list[tuple[int, int]], edges, sign: int):
        self.edges, self.sign = edges, sign
        self.cost = {n: 0 for n in sources}
        self.audit = {n: "" for n in sources}
        self.heap = [(0, sign * n[0], n[1]) for n in sources]
        heapq.heapify(self.heap)
        self.settled: set[tuple[int, int]] = set()

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        c, i, state = heapq.heappop(self.heap)
        node = (self.sign * i, state)
        self.settled.add(node)
        mine = self.audit[node]
        for w, edit, j, target in self.edges(*node):
            to, total = (j, target), c + w
            audit = mine + edit if self.sign > 0 else edit + mine
            known = self.cost.get(to)
            if known is None or total < known:
                self.cost[to], self.audit[to] = total, audit
                heapq.heappush(self.heap, (total, self.sign * j, target))
            elif total == known and audit < self.audit[to]:
                self.audit[to] = audit
        return node


def least_edits(rows: list[Row], start: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, audit, end state) of the cheapest repair from a state to one of ``ends``, ties by audit; None: no way."""
    n = len(rows)
    ahead = _Side([(0, start)], lambda i, s: _after(rows, i, s), 1)
    back = _Side([(n, e) for e in ends], lambda i, s: _before(rows, i, s), -1)
    best = float("inf")
    while True:
        f, b = ahead.top(), back.top()
        if f + b > best or f + b == float("inf"):
            break
        side, other = (ahead, back) if f <= b else (back, ahead)
        node = side.settle()
        if node in other.cost:
            best = min(best, side.cost[node] + other.cost[node])
    found = []
    for node in ahead.settled:
        c, audit = ahead.cost[node], ahead.audit[node]
        if node[0] == n and node[1] in ends and c == best:
            found.append((audit, node[1]))
        for w, edit, j, target in _after(rows, *node):
            to = (j, target)
            if to in back.settled and c + w + back.cost[to] == best:
                found.append((audit + edit + back.audit[to], None))
    if not found:
        return None
    audit, end = min(found, key=lambda x: x[0])
    return int(best), audit, replay(rows, audit, start) if end is None else end


def replay(rows: list[Row], audit: str, start: int) -> int:
    """State after the edits."""
    state, i = start, 0
    for edit in audit:
        if edit == "K":
            state = KEEP[(state, rows[i].initial)]
        elif edit != "D":
            state = NEXT[state]
        i += edit != "I"
    return state


@dataclass
class _Way:
    """The cheapest edits so far that end in one state, and the digest of the rows they write."""
    cost: int
    audit: str
    digest: object
    empty: bool

    def extended(self, cost: int, audit: str, start: int, rows: list[Row], texts: list[tuple[str, str]]) -> _Way:
        digest, empty, state, i = self.digest.copy(), self.empty, start, 0
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            role, text = texts[i] if edit != "I" else ("", "")
            if edit == "K":
                state = KEEP[(state, rows[i].initial)]
            else:
                state = NEXT[state]
                role = ROLE[state]
            i += edit != "I"
            digest.update((("" if empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
            empty = False
        return _Way(self.cost + cost, self.audit + audit, digest, empty)


class Repair:
    """One conversation, row by row in order."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.ways = {START: _Way(0, "", hashlib.sha256(), True)}
        self.rows: list[Row] = []
        self.texts: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, role: str, text: str, blank: bool, duplicate: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut = cut and not blank and not duplicate
        self.truncated += cut
        self.rows.append(Row(initial, blank or duplicate, cut))
        self.texts.append((role, text))
        if len(self.rows) > self.block:
            self._close(False)

    def _close(self, last: bool) -> None:
        """Search the rows held (all but the newest, unless they are the last) and keep the ways through."""
        rest = [] if last else self.rows[-1:]
        rows = self.rows if last else self.rows[:-1]
        texts = self.texts[:len(rows)]
        out: dict[int, tuple] = {}
        for start, way in self.ways.items():
            for ends in ((ENDS,) if last else ((START,), (SYSTEM,), (USER,), (ASSISTANT,))):
                found = least_edits(rows, start, ends)
                if found is None:
                    continue
                key = -1 if last else found[2]
                now = (way.cost + found[0], way.audit + found[1], start, found)
                if key not in out or now[:2] < out[key][:2]:
                    out[key] = now
        self.ways = {k: self.ways[start].extended(f[0], f[1], start, rows, texts) for k, (_, _, start, f) in out.items()}
        self.rows, self.texts = rest, self.texts[len(rows):]

    def finish(self) -> _Way:
        self._close(True)
        return self.ways[-1]


WHITE = r"\x20\x09-\x0D"


def named(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped after the damage that crc32 of ``conv_id:turn`` picks (a dropped row stays, marked)."""
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (F.col("kind") == 0).alias("dropped"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``blank``, ``cut`` (the last character that isn't white is not ``[.!?]``) and ``again`` (an earlier
    turn has the role and text; repeats within a turn are for the reader, to whom they come adjacent).

    Texts that a conversation repeats are found by a grouped minimum of two 64-bit
    hashes; only repeated ones are joined back, and a hot one may be split there.
    """
    conv, turn = named("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("t"))
    rows = rows.withColumns({
        "blank": ~F.col("text").rlike(f"[^{WHITE}]"),
        "cut": ~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"),
        "h1": F.xxhash64(conv, "role", "text"), "h2": F.xxhash64(F.lit(7), "text", "role", conv), "at": turn})
    said = rows.filter(~F.col("dropped") & ~F.col("blank"))
    first = said.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter(F.col("first") < F.col("last"))
    out = rows.join(first.select("h1", "h2", "first"), ["h1", "h2"], "left")
    return out.select("conv_id", "turn", "role", "text", "dropped", "blank", "cut",
                      F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"))


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repair of every conversation of ``conversations`` (conv_id, turn, role, text, dropped)."""
    per_batch(conversations.sparkSession, 2000)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = faults(conversations).repartition("conv_id").sortWithinPartitions(*order)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        key, state, before = None, None, None
        turns: list[int] = []  # least, greatest and number of distinct turns

        def line():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            way = state.finish()
            return (key[0], gaps, state.blank, state.duplicate, state.truncated, state.illegal, way.cost, way.audit, way.digest.hexdigest())

        for b in batches:
            out = []
            for conv, turn, role, text, dropped, blank, cut, again in zip(*[c.to_pylist() for c in b.columns]):
                if key != (conv,):
                    if key is not None:
                        out.append(line())
                    key, state, before, turns = (conv,), Repair(block), None, []
                if dropped:
                    continue
                if turn is not None:
                    if not turns:
                        turns = [turn, turn, 1]
                    elif turn != turns[1]:
                        turns = [turns[0], turn, turns[2] + 1]
                now = (turn, role, text)
                state.add(role, text, blank, again or now == before, cut)
                before = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
                                                  for n, c in zip(names, zip(*out))], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n in ("audit", "repaired_sha256") else pa.int64())
                                              for n, v in zip(names, line())], names)

    return rows.mapInArrow(run, RESULT)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation after the contract's damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair(damaged(rows))
