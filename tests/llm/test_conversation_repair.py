import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from quern.llm import conversation_repair as C
from quern.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, seg int, cost string, `a b` int, h string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        d, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        role, text = "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, found, audit):
    """(cost, turns) of an audit, each letter tried as the grammar has it; None if it can't be."""
    got, cost, k = [], 0, 0
    for letter in audit:
        want = "user" if not got or got[-1][0] != "user" else "assistant"
        if letter == "I":
            got.append((want, ""))
            cost += 2
            continue
        if k == len(rows):
            return None
        (role, text), fault, k = rows[k], found[k], k + 1
        if letter == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += fault == "truncated"
        if letter == "R":
            got.append((want, text))
            cost += 2
        else:
            got.append((role, text))
    initials = "".join(r[:1] or "-" for r, _ in got)
    return (cost, got) if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials) else None


def brute(rows):
    """The cheapest audit, the ASCII-least of equals, out of all."""
    found, best = faults(rows), None
    for n in range(len(rows), 2 * len(rows) + 3):
        for letters in itertools.product("DIKR", repeat=n):
            if letters.count("I") == n - len(rows) and (got := applied(rows, found, letters)) is not None:
                one = (got[0], "".join(letters), got[1])
                best = one if best is None or one[:2] < best[:2] else best
    return best


def ordered(rows):
    h = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], h(x[2], x[3])))


def sql(rows):
    con = duckdb.connect()
    table = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])})
    con.register("conversations", table)
    return {r[0]: r[1:] for r in con.sql(queries.ORACLES["op11_conversation_repair"]).fetchall()}


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def summaries(spark, rows):
    got = C.summaries(C.damaged(made(spark, rows))).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_against_all_audits(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 3)):
            rows.append((c, t + (t > 1), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rng.choice(["Hi.", "No end", "", " ", "So!", "Why?\n"])))
    got = summaries(spark, rows)
    for c in range(60):
        mine = [r[2:] for r in ordered([r for r in damaged(rows) if r[0] == c])]
        cost, audit, turns = brute(mine) if mine else (0, "", [])
        assert got[c][5:7] == (cost, audit), (c, mine)
        assert got[c][7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert got[c][1:4] == tuple(faults(mine).count(f) for f in ("blank", "duplicate", "truncated"))


def awkward_conversations():
    rng = random.Random(5)
    role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", "user", "assistant", None, "tool"])
    text = lambda: rng.choice(["A text.", "Another one!", "No end", "", None, " \n", "Ends?  ", "é ñ 😀.", "w " * rng.randint(1, 40) + "."])
    rows = [(c, t, role(), text()) for c in range(200) for t in range(rng.randint(1, 9))]
    rows += [(None, t, role(), text()) for t in range(6)] + [(900, None, role(), text()) for _ in range(4)] + [(901, 4, role(), text()) for _ in range(5)]
    rows += [(902, 7, "user", "Same.")] * 5 + [(903, 10**6, "user", "x" * 300_000 + "."), (903, -5, "assistant", "y.")]
    return rows


def test_awkward_rows_against_sql(spark):
    rows = awkward_conversations()
    assert summaries(spark, rows) == sql(rows)


def test_a_conversation_over_many_tasks(spark):
    """One holds most rows, with repeats across its whole length; pieces are small."""
    rng = random.Random(8)
    rows = [(7, t if t % 50 else None, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Fine.", f"Turn {t}.", f"Turn {t}", ""])) for t in range(1500)]
    rows += [(c, t, "user", f"{c} {t}.") for c in (3, 9) for t in range(4)]
    held, C.HELD = C.HELD, 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = summaries(spark, rows)
        turns = C.repaired(C.damaged(made(spark, rows))).orderBy("conv_id", "no").collect()
    finally:
        C.HELD = held
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sql(rows)
    for c in (3, 7, 9):
        lines = [f"{t['role']}:{t['text']}" for r in turns if r["conv_id"] == c for t in r["turns"]]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[c][7]


def test_empty(spark):
    assert summaries(spark, []) == {}
    assert C.repaired(C.damaged(made(spark, []))).collect() == []


@pytest.mark.parametrize("costs", range(4))
def test_costs_to_go_on(costs):
    """BEYOND holds for every short way on: going on from x costs at most so much more than from y."""
    ways = list(itertools.product([("u", False), ("a", False), ("s", False), ("a", True)], repeat=3))

    def total(state, way):
        best = C.Best([(0, "") if k == state else None for k in range(4)])
        best.now = best.closed(best.now)
        for initial, required in way:
            best.turn(initial, required, False)
        return min(got[0] for k, got in enumerate(best.whole()) if k in (C.NOTHING, C.ASSISTANT) and got is not None)

    for y in range(4):
        assert all(total(costs, way) <= total(y, way) + C.BEYOND[costs][y] for way in ways)
