"""Conversation repair against exhaustive search and SQL, and its edge cases."""

import hashlib
import random
import re
from itertools import product

import duckdb
import pyarrow as pa
import pytest

from strandline.llm import conversations as c

KINDS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
ROLES = ["user", "assistant", "assistant", "user", "system", "tool", None, "", "Über"]


def some_rows(seed, ids=40, sizes=(1, 3, 9, 40, 120)):
    pick, rows = random.Random(seed), []
    for conv in [None, -3, *range(ids)]:
        for turn in range(pick.choice(sizes)):
            texts = ["Hi.", "ok", "yes!", " ", None, "What?", "no. \t", "", f"a {turn}.", f"b{turn}", f"日本 {turn}!"]
            row = (conv, pick.choice([turn, turn, None, turn // 2, turn + 5]), pick.choice(ROLES), pick.choice(texts))
            rows += [row] * pick.choice([1, 1, 1, 3])
    return rows


def by_sql(rows):
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(KINDS.names, r)) for r in rows], schema=KINDS))
    found = con.sql(c.OP12_SQL)
    return found.columns, sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("chunk", [512, 4, 1])
def test_repair_equals_sql(spark, chunk):
    rows = some_rows(7)
    columns, want = by_sql(rows)
    extra = "conv_id long, turn long, role string, text string, conv string, at int, audit string, cost int"
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], extra)
    assert sorted(map(repr, map(tuple, c.repaired(c.damaged(frame), chunk).select(*columns).collect()))) == want


def test_one_conversation_that_is_nearly_all_rows(spark):
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", f"text {k % 900}.") for k in range(3000)] + [(5, 4000, "user", "spam.")] * 2000 + [(6, 0, "user", "a.")]
    columns, want = by_sql([r for r in rows if r[0] == 6])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in c.repaired(c.damaged(frame), 64).collect()}
    assert repr(tuple(found[6][k] for k in columns)) in want
    whole = {r["conv_id"]: r for r in c.repaired(c.damaged(frame), 100_000).collect()}
    assert found[5] == whole[5]
    assert found[5]["duplicate"] > 3000


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.repaired(c.damaged(none)).count() == 0
    dropped = spark.createDataFrame([(1, 0, "user", "a.", 0)], "conv_id long, turn long, role string, text string, copies int")
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in c.repaired(dropped).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", empty)]


def all_edits(steps):
    """(cost, audit) of every edit of up to three insertions whose roles are well formed."""
    found = []

    def go(at, state, cost, audit, inserted):
        if at == len(steps) and state in c.ACCEPTED:
            found.append((cost, audit))
        if inserted < 3:
            for x, y in c.EITHER:
                if x == state:
                    go(at, y, cost + 5, audit + "I", inserted + 1)
        if at < len(steps):
            for x, y, more, letters in c._ways(steps[at]):
                if x == state:
                    go(at + 1, y, cost + more, audit + letters, inserted)

    go(0, c.NOTHING, 0, "", 0)
    return min(found)


def test_search_is_exhaustive_search():
    kinds = [(0, "s", False), (0, "u", False), (0, "u", True), (0, "a", False), (0, "a", True), (0, "t", False), (2, "", False)]
    for n in range(4):
        for steps in product(kinds, repeat=n):
            assert c.cheapest(list(steps)) == all_edits(list(steps))
    pick = random.Random(3)
    for _ in range(30):
        steps = [pick.choice(kinds) for _ in range(6)]
        assert c.cheapest(steps) == all_edits(steps)


def test_composed_chunks_are_the_whole():
    pick = random.Random(4)
    kinds = [(0, x, t) for x in "suat" for t in (False, True)] + [(1, "", False), (3, "", False)]
    for _ in range(60):
        steps = [pick.choice(kinds) for _ in range(pick.randrange(12))]
        cuts = sorted(pick.randrange(len(steps) + 1) for _ in range(3))
        parts = [steps[a:b] for a, b in zip([0, *cuts], [*cuts, len(steps)])]
        tables = [c.pair_table(p) for p in parts]
        cost, taken = c.choose([t[0] for t in tables], [t[1] for t in tables])
        audit = "".join(t[2][k] for t, k in zip(tables, taken)) + c.CLOSING_AUDITS[taken[-1] % 4]
        assert (cost, audit) == c.cheapest(steps)


def test_repaired_roles_are_well_formed():
    pick = random.Random(9)
    for _ in range(200):
        rows = [(str(k), pick.choice(["user", "assistant", "system", "x"]), f"t{pick.randrange(4)}.", pick.choice([1, 1, 2]), True) for k in range(pick.randrange(9))]
        part = c.Part(rows)
        _, audit = c.cheapest(part.steps)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in part.repaired(audit)))
