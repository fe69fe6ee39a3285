"""Conversation repair against a row-by-row table of least edits, and the query against SQL on awkward rows."""

import hashlib
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barsignals.llm import repair
from barsignals.llm.oracle import ORACLE
from barsignals.llm.repair import ENDS, START, Repair, Row, least_edits, op11_conversation_repair

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WRITES = {"": "u", "s": "u", "u": "a", "a": "u"}


def table(rows):
    """Least (cost, audit) of the whole list, by a table over (row, last role)."""
    def inserted(ways):
        for _ in range(2):
            for s, (c, a) in list(ways.items()):
                ways[WRITES[s]] = min(ways.get(WRITES[s], (99 ** 9, "")), (c + 2, a + "I"))
        return ways

    ways = inserted({"": (0, "")})
    for r in rows:
        new = {}
        for s, (c, a) in ways.items():
            steps = [(s, 3, "D")]
            if not r.must_go:
                steps.append((WRITES[s], 2 + r.cut, "R"))
                if (s, r.initial) in MOVES:
                    steps.append((MOVES[(s, r.initial)], r.cut, "K"))
            for t, w, e in steps:
                new[t] = min(new.get(t, (99 ** 9, "")), (c + w, a + e))
        ways = inserted(new)
    return min(ways[s] for s in ("", "a") if s in ways)


def some_rows(rng, n, odd=0.3):
    out = []
    for k in range(n):
        initial = "ua"[k % 2] if rng.random() > odd else rng.choice(["s", "u", "a", "t", ""])
        out.append(Row(initial, rng.random() < odd / 2, rng.random() < odd))
    return out


@pytest.mark.parametrize("odd", [0.1, 0.5, 1.0])
def test_least_edits(odd):
    rng = random.Random(int(odd * 10))
    for _ in range(400):
        rows = some_rows(rng, rng.randint(0, 12), odd)
        assert least_edits(rows, START, ENDS)[:2] == table(rows)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_do_not_change_the_repair(block):
    rng = random.Random(block)
    for _ in range(40):
        rows = some_rows(rng, rng.randint(0, 40), 0.6)
        whole, parts = Repair(1 << 20), Repair(block)
        for k, r in enumerate(rows):
            for x in (whole, parts):
                x.add(r.initial, f"text {k}", r.must_go, False, r.cut)
        a, b = whole.finish(), parts.finish()
        # a row that must go is blank here, so it isn't truncated as well
        want = table([Row(r.initial, r.must_go, r.cut and not r.must_go) for r in rows])
        assert (a.cost, a.audit, a.digest.hexdigest()) == (b.cost, b.audit, b.digest.hexdigest()) and (a.cost, a.audit) == want


def write(folder, rows):
    n = len(rows)
    extra = {c: pa.array([float(k) for k in range(n)], pa.float64()) for c in ("kind", "copy", "first", "h1", "blank", "cost", "at")}
    pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
                             "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string()),
                             **extra}), f"{folder}/conversations.parquet")
    return str(folder)


def awkward_rows():
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire", "User"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \t\n", None, "é ▁ 😀.", "End.\x0b\r", "end. ", "Yes."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            role = "user assistant".split()[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(texts)
            rows.append((conv, turn, role, f"{text}{turn}." if rng.random() < 0.4 else text))
        if rng.random() < 0.3:  # one turn several times, also without a number
            rows += [(conv, rng.choice([0, 3, None, 40]), "user", "Same.") for _ in range(3)]
    rows += [(None, k % 7 if k % 3 else None, rng.choice(roles), rng.choice(texts)) for k in range(40)]
    rows += [(1000, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "user", f"Row {k}" + ".?"[k % 5 == 0] * (k % 9 > 0)) for k in range(700)]
    rows += [(2000, None, "user", "x " * 200_000 + "."), (2000, 5, "assistant", "y" * 300_000)]
    rows += [(3000 + k, 0, "user", "Only.") for k in range(30)]  # some lose their only row
    return rows + rows[:20]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("conversations"), awkward_rows())


def test_query_on_awkward_rows(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    found = con.execute(ORACLE["op11_conversation_repair"])
    names = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    out = op11_conversation_repair(spark, folder)
    assert Counter(tuple(r[c] for c in names) for r in out.collect()) == want
    assert any(r[0] is None for r in want) and any(r[names.index("audit")] == "" for r in want)


def test_small_blocks_give_the_same_query(spark, folder):
    rows = repair.damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    a = {tuple(r) for r in repair.repair(rows).collect()}
    assert a == {tuple(r) for r in repair.repair(rows, block=7).collect()}


def test_empty_table(spark, tmp_path):
    out = op11_conversation_repair(spark, write(tmp_path, []))
    assert out.columns == [f.split()[0] for f in repair.RESULT.split(", ")] and out.count() == 0


def test_a_dropped_conversation_gives_zeros(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, dropped boolean")
    assert tuple(repair.repair(rows).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
