"""Merkle manifests against hashing by hand, and their edge cases."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from strandline.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, base long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    fields = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    return [([row[k // 2**n ^ 1]] if k // 2**n ^ 1 < len(row) else [], k // 2**n % 2) for n, row in enumerate(levels[:-1])]


def by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted([(r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == x]) for x in langs}
    levels = {x: up([t[2] for t in trees[x]]) for x in langs}
    top = up([levels[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for k, (_, _, own, r) in enumerate(trees[x]):
            steps = path(levels[x], k) + path(top, at)
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for sibling, left in steps:
                node = h(*(sibling + [node] if left else [node] + sibling))
            proof = h(*[s for sibling, _ in steps for s in sibling])
            out.append((r[0], own, levels[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


EDGES = [
    (1, "s", "en", 3, "abc"), (2, "s", "en", None, None), (2, "s", "en", None, None), (2, "t", "en", 4, ""), (None, None, None, None, None),
    (None, None, None, None, None), (7, "s", "é", 9, "größer 日本"), (8, "s", "z", 1, "x" * 70_000), (9, "s", "", 0, " \n"), (-5, "s", "en", 1, "y"),
]
MANY = [(k * 3 % 101, "s", "en" if k % 3 else "de", k, f"text {k}") for k in range(101)]
COPIES = [(5, "s", "en", 1, "same")] * 45 + [(6, "s", "en", 1, "other")] * 5


@pytest.mark.parametrize("rows", [EDGES, EDGES[:1], MANY, COPIES, []])
@pytest.mark.parametrize("bits", [1, 3])
def test_manifest_is_that_by_hand(spark, rows, bits):
    docs = spark.createDataFrame([(*r, "t", 5, 6) for r in rows], SCHEMA)
    found = sorted((tuple(r) for r in manifest.verified_documents(docs, bits).collect()), key=repr)
    assert found == by_hand(rows)


@pytest.mark.parametrize("rows", [EDGES, MANY, COPIES, []])
def test_sql_on_edge_cases(rows):
    kinds = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())])
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(kinds.names, r)) for r in rows], schema=kinds))
    assert sorted(con.sql(manifest.OP13_SQL).fetchall(), key=repr) == by_hand(rows)


def test_positions_are_those_of_a_postorder_walk():
    for n in range(1, 80):
        order = []

        def walk(level, index):
            if level:
                walk(level - 1, 2 * index)
                if 2 * index + 1 < manifest.width(n, level - 1):
                    walk(level - 1, 2 * index + 1)
            order.append((level, index))

        walk(manifest.height(n), 0)
        assert [manifest.position(level, index, n) for level, index in order] == list(range(len(order)))


def test_log_of_a_block_is_one_run_in_completion_order():
    for n in (1, 2, 5, 8, 11, 16, 21):
        for first in range(0, n, 8):
            leaves = [h(str(k)) for k in range(first, min(n, first + 8))]
            log = manifest.block_log(leaves, first, 0, n, 3)
            places = [manifest.position(level, index, n) for level, index, _ in log]
            assert places == list(range(places[0], places[0] + len(places)))
            assert log[-1][2] == up(leaves)[-1][0] or len(leaves) < 8 <= n


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(k, "s", "en", k if k % 2 else None, "t") for k in range(60)], SCHEMA.split(", tree")[0])
    for r in manifest.verified_documents(docs).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0 or r["doc_id"] % 2 == 0)
