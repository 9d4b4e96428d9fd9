"""Merkle manifest of a dataset: a postorder append log of hash trees, and proofs read from it by position.

A document is a leaf: the lowercase hex SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value. The
leaves of a language, in order of doc_id, form one binary tree (a node without a partner is hashed alone); the roots of the
languages, in order of their names, form another, whose root stands for the dataset. Digests enter hashes as hex text.

A tree's nodes are logged in the order in which they are completed: a node follows its subtrees, nodes over the ragged
right edge come last. So a node's place is known from the sizes of the subtrees before it (`position`), without looking anything up:
2 j - popcount(j) nodes are complete before leaf j, and a full node of level h comes h places after its last leaf.

Leaves get their place in their tree from range partitions and one count for each and are dealt to builders
of `2**BLOCK_BITS` aligned leaves. A builder writes the nodes of its block in completion order: one run of consecutive positions.
The blocks' roots are dealt to builders in the same way, and so on, until each tree has one node; the number of rounds is the logarithm of
the largest tree to the base `2**BLOCK_BITS`. No task holds more than one block at a time and nothing but counts of rounds reaches the driver.
A proof is extracted by addressing each level's sibling in the log: within the block's own run by its offset, above by a join on
the position, once for a block. Proofs of the tree of languages are extracted by the same code.

Defined edge results: a null doc_id comes first in its language and is never tampered with; rows that repeat a doc_id are
leaves of their own, in order of their digests (equal rows are interchangeable); a null language is a tree of its own, which comes
first; an empty table has no rows; the proof of the only leaf of the only language has no siblings and is the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored

BLOCK_BITS = 10
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7


def digest_of(*parts: str) -> str:
    """H: the lowercase hex SHA-256 of its inputs, concatenated."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """The level of the root over n leaves."""
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    """How many nodes a level has."""
    return (n + (1 << level) - 1) >> level


def position(level: int, index: int, n: int) -> int:
    """The place of a node in the postorder log of a tree of n leaves."""
    if (index + 1) << level <= n:
        last = ((index + 1) << level) - 1
        return 2 * last - last.bit_count() + level
    first_ragged = (n & -n).bit_length()  # the least level whose last node is not full
    return 2 * n - n.bit_count() + level - first_ragged


def block_log(nodes: list[str], first: int, level: int, n: int, bits: int = BLOCK_BITS) -> list[tuple[int, int, str]]:
    """(level, index, digest) in completion order of what stands over `nodes`, the nodes first, first + 1, ... of `level`, themselves included.

    `first` is a multiple of `2**bits`, and a block that is not the tree's last has `2**bits` nodes. Ends `bits` levels higher or at the tree's root.
    """
    levels = [nodes]
    while level + len(levels) <= min(level + bits, height(n)):
        below = levels[-1]
        levels.append([digest_of(*below[k : k + 2]) for k in range(0, len(below), 2)])

    def full(up: int, k: int) -> bool:
        return ((first >> up) + k + 1) << (level + up) <= n

    found = []
    for k in range(len(nodes)):
        found.append((level, first + k, nodes[k]))
        up, at = 0, k
        while at & 1 and up + 1 < len(levels) and full(up + 1, at >> 1):
            up, at = up + 1, at >> 1
            found.append((level + up, (first >> up) + at, levels[up][at]))
    for up in range(1, len(levels)):
        at = len(levels[up]) - 1
        if not full(up, at):
            found.append((level + up, (first >> up) + at, levels[up][at]))
    return found


def fold(leaf: str, path: list[tuple[str | None, bool]]) -> str:
    """The root over `leaf`: at each level its sibling (None: it has none) stands on the left or on the right."""
    for sibling, left in path:
        leaf = digest_of(leaf) if sibling is None else digest_of(sibling, leaf) if left else digest_of(leaf, sibling)
    return leaf


def proof_of(path: list[tuple[str | None, bool]]) -> str:
    """H of the siblings from the leaf to the root."""
    return digest_of(*[sibling for sibling, _ in path if sibling is not None])


@dataclass
class Trees:
    """Written hash trees.

    blocks(tree, block, n, base, members, run): `members` are the leaves' structs in order, `run` the digests of the block's nodes, one after
    the other, in log order from position `base` on. upper(tree, position, digest): the log from the blocks' roots up.
    roots(tree, root).
    """

    blocks: DataFrame
    upper: DataFrame
    roots: DataFrame


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The leaf over `FIELDS`, from a column for each."""
    value = [columns[f].cast("string") for f in FIELDS]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value]
    return F.sha2(F.concat(*parts), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, member): `tree` is the language; the member holds doc_id, leaf and, where it is tampered with, the other leaf."""
    own = {f: F.col(f) for f in FIELDS}
    changed = own | {"n_chars": F.col("n_chars") + 1}
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    member = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("leaf"), F.when(chosen, leaf_digest(changed)).alias("tampered")
    )
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("id"), member.alias("member"))


def placed(leaves: DataFrame, order: str) -> DataFrame:
    """`leaves` (tree, `order`, member) with `place`, from 0, in the tree and `n`, the number of the tree's leaves."""
    # Equal rows are told apart by a number, so that a row repeated any number of times doesn't fall into one partition.
    rows = stored(leaves.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", order, "member.leaf", "nth"]
    dealt = stored(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt-leaves")
    # A row for each tree and partition that share leaves.
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select("tree", "part", before.alias("before"), F.sum("here").over(tree).alias("n")), "offsets")
    row = F.row_number().over(Window.partitionBy("part", "tree").orderBy(order, "member.leaf", "nth"))
    ranked = dealt.withColumn("row", row).alias("d")
    same = F.col("d.tree").eqNullSafe(F.col("o.tree")) & (F.col("d.part") == F.col("o.part"))
    found = ranked.join(offsets.alias("o"), same)
    return found.select("d.tree", "d.member", (F.col("row") + F.col("before") - 1).cast("long").alias("place"), F.col("n").cast("long").alias("n"))


def _blocks(rows: DataFrame, value: str, bits: int) -> DataFrame:
    """Aligned blocks of `2**bits` rows (tree, place, n, `value`): (tree, block, n, members in order)."""
    own = F.collect_list(F.struct("place", value))
    found = rows.groupBy("tree", F.shiftright("place", bits).alias("block"), "n").agg(F.array_sort(own).alias("m"))
    return found.select("tree", "block", "n", F.transform("m", lambda x: x[value]).alias("members"))


def build(leaves: DataFrame, order: str = "id", bits: int = BLOCK_BITS) -> Trees:
    """The trees over `leaves` (tree, `order`, member with `leaf`), each written by aligned builders."""

    @F.pandas_udf("string")
    def run(leaf: pd.Series, block: pd.Series, n: pd.Series) -> pd.Series:
        logs = [block_log(list(x), int(k) << bits, 0, int(size), bits) for x, k, size in zip(leaf, block, n)]
        return pd.Series(["".join(d for _, _, d in log) for log in logs], dtype=object)

    first = F.shiftleft("block", bits)
    dealt = _blocks(placed(leaves, order), "member", bits)
    dealt = dealt.withColumn("base", (2 * first - F.bit_count(first)).cast("long"))
    blocks = stored(dealt.withColumn("run", run(F.col("members.leaf"), "block", "n")), "log-blocks")

    def merge(level: int):
        @F.pandas_udf("array<struct<level:int,index:bigint,position:bigint,digest:string>>")
        def merged(nodes: pd.Series, block: pd.Series, n: pd.Series) -> pd.Series:
            rows = []
            for x, k, size in zip(nodes, block, n):
                log = block_log(list(x), int(k) << bits, level, int(size), bits)
                rows.append([{"level": h, "index": i, "position": position(h, i, int(size)), "digest": d} for h, i, d in log if h > level])
            return pd.Series(rows, dtype=object)

        return merged

    # The last digest of a run is the block's root.
    level = bits
    ends = F.substring("run", -DIGEST, DIGEST).alias("digest")
    nodes = stored(blocks.select("tree", F.col("block").alias("place"), "n", ends), "block-roots")
    upper = nodes.select("tree", _position(F.lit(level), F.col("place"), F.col("n")).alias("position"), "digest")
    roots = nodes.where(F.col("n") <= 1 << level).select("tree", F.col("digest").alias("root"))
    left = nodes.where(F.col("n") > 1 << level)
    while not left.isEmpty():
        found = _blocks(left, "digest", bits).select("tree", "n", F.explode(merge(level)("members", "block", "n")).alias("x"))
        found = stored(found.select("tree", "n", "x.*"), "upper-nodes")
        upper = upper.union(found.select("tree", "position", "digest"))
        level += bits
        nodes = found.where(F.col("level") == F.least(F.lit(level), _height("n"))).select("tree", F.col("index").alias("place"), "n", "digest")
        roots = roots.union(nodes.where(F.col("n") <= F.shiftleft(F.lit(1).cast("long"), level)).select("tree", F.col("digest").alias("root")))
        left = nodes.where(F.col("n") > F.shiftleft(F.lit(1).cast("long"), level))
    return Trees(blocks, upper, stored(roots, "roots"))


def _height(n: str) -> Column:
    """`height` as a column expression."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


def _position(level: Column, index: Column, n: Column) -> Column:
    """`position` as a column expression."""
    last = (index + 1) * F.pow(F.lit(2), level).cast("long") - 1
    first_ragged = F.bit_count(n.bitwiseXOR(n - 1))
    ragged = 2 * n - F.bit_count(n) + level - first_ragged
    return F.when(last < n, 2 * last - F.bit_count(last) + level).otherwise(ragged).cast("long")


def upper_paths(trees: Trees, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, block, above): each block's siblings from its root up, as structs (level, sibling, left); a missing one is null."""
    level = F.explode(F.sequence(F.lit(bits), F.greatest(_height("n") - 1, F.lit(bits)))).alias("level")
    rows = trees.blocks.where(F.col("n") > 1 << bits).select("tree", "block", "n", level)
    own = F.floor(F.col("block") / F.pow(F.lit(2), F.col("level") - bits)).cast("long")
    rows = rows.withColumn("sibling", own.bitwiseXOR(F.lit(1).cast("long"))).withColumn("left", own % 2 == 1)
    exists = F.col("sibling") * F.pow(F.lit(2), F.col("level")).cast("long") < F.col("n")
    rows = stored(rows.withColumn("position", F.when(exists, _position(F.col("level"), F.col("sibling"), F.col("n")))), "sibling-positions")
    same = F.col("r.tree").eqNullSafe(F.col("u.tree")) & (F.col("r.position") == F.col("u.position"))
    met = rows.alias("r").join(trees.upper.alias("u"), same, "left").select("r.tree", "r.block", "r.level", "u.digest", "r.left")
    step = F.struct("level", F.col("digest").alias("sibling"), "left")
    return stored(met.groupBy("tree", "block").agg(F.array_sort(F.collect_list(step)).alias("above")), "upper-paths")


def paths_in_block(run: str, n_members: int, first: int, base: int, n: int, bits: int = BLOCK_BITS) -> list[list[tuple[str | None, bool]]]:
    """For each leaf of a block its siblings within the block, read from the run by their positions."""
    top = min(bits, height(n))
    siblings: list[dict[int, str | None]] = []
    for level in range(top):
        found: dict[int, str | None] = {}
        for index in range(first >> level, ((first + n_members - 1) >> level) + 1):
            other = index ^ 1
            at = (position(level, other, n) - base) * DIGEST if other < width(n, level) else None
            found[index] = None if at is None else run[at : at + DIGEST]
        siblings.append(found)
    return [[(siblings[level][k >> level], bool(k >> level & 1)) for level in range(top)] for k in range(first, first + n_members)]


def proofs(trees: Trees, beyond: DataFrame | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, leaf, doc_id, path) or, given `beyond` (tree, path), (tree, leaf, doc_id, proof_sha256, folded_root).

    `path` is an array of structs (sibling, left) from the leaf to the tree's root; `beyond` continues it from there. The folded root
    begins with the tampered leaf where there is one.
    """
    same = F.col("b.tree").eqNullSafe(F.col("p.tree")) & (F.col("b.block") == F.col("p.block"))
    rows = trees.blocks.alias("b").join(upper_paths(trees, bits).alias("p"), same, "left").select("b.*", "p.above")
    step = "array<struct<sibling: string, left: boolean>>"
    keep_path = beyond is None
    whole = "path " + step if keep_path else "proof_sha256 string, folded_root string"
    if beyond is None:
        rows = rows.withColumn("beyond", F.lit(None).cast(step))
    else:
        rows = rows.alias("r").join(beyond.alias("y"), F.col("r.tree").eqNullSafe(F.col("y.tree")), "left")
        rows = rows.select("r.*", F.col("y.path").alias("beyond"))
    ids = F.transform("members", lambda m: m["doc_id"].cast("string"))  # as text, since nulls would turn longs into floats
    rows = rows.select("tree", "block", "base", "n", "run", ids.alias("ids"), F.col("members.tampered").alias("tampered"), "above", "beyond")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                first, n = int(r.block) << bits, int(r.n)
                rest = [(s["sibling"], s["left"]) for part in (r.above, r.beyond) if part is not None for s in part]
                found = paths_in_block(r.run, len(r.ids), first, int(r.base), n, bits)
                out: dict[str, list] = {"tree": [r.tree] * len(found), "id": list(r.ids), "leaf": [], "path": [], "proof_sha256": [], "folded_root": []}
                for k, inner in enumerate(found):
                    at = (position(0, first + k, n) - int(r.base)) * DIGEST
                    leaf, path = r.run[at : at + DIGEST], inner + rest
                    out["leaf"].append(leaf)
                    if keep_path:
                        out["path"].append([{"sibling": s, "left": x} for s, x in path])
                    else:
                        out["proof_sha256"].append(proof_of(path))
                        out["folded_root"].append(fold(r.tampered[k] or leaf, path))
                yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items() if v})

    found = rows.mapInPandas(extract, f"tree string, id string, leaf string, {whole}")
    return found.withColumn("doc_id", F.col("id").cast("long")).drop("id")


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> tuple[Trees, Trees]:
    """The trees of the languages of `docs`, and the tree over their roots."""
    trees = build(document_leaves(docs), "id", bits)
    none = F.lit(None)
    member = F.struct(none.cast("long").alias("doc_id"), F.col("root").alias("leaf"), none.cast("string").alias("tampered"))
    # One row for each language; the only tree has no name.
    tops = trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), member.alias("member"))
    return trees, build(tops, "name", bits)


def verified_documents(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of `docs`."""
    trees, top = manifest(docs, bits)
    named = trees.roots.select(F.col("tree").alias("lang"), F.col("root").alias("subroot"))
    # Equal roots (a language can't have another's, as leaves hold it) have equal paths but for their place: pair by digest.
    beyond = proofs(top, None, bits).join(top.roots, "tree").select(F.col("leaf").alias("subroot"), "path", "root")
    whole = stored(named.join(beyond, "subroot"), "paths-of-languages")
    found = proofs(trees, whole.select(F.col("lang").alias("tree"), "path"), bits)
    same = F.col("f.tree").eqNullSafe(F.col("w.lang"))
    out = found.alias("f").join(whole.select("lang", "subroot", "root").alias("w"), same)
    columns = ["f.doc_id", "f.leaf", "w.subroot", "w.root", "f.proof_sha256", "f.folded_root"]
    return out.select(*columns, (F.col("f.folded_root") == F.col("w.root")).alias("verified"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's leaf, roots and proof, and whether it verifies after the tampering."""
    return verified_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_LEAF = "sha256({} || {} || {} || {} || {})"
_PLAIN = _LEAF.format(*[_field(f"CAST({f} AS VARCHAR)") for f in FIELDS])
_CHANGED = _LEAF.format(*[_field(f"CAST({f}{' + 1' if f == 'n_chars' else ''} AS VARCHAR)") for f in FIELDS])
#: CRC-32 of a text of ASCII characters, bit by bit.
CRC32_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: "
    "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT)"
)
#: Levels are folded one after the other; every leaf looks its siblings up by level and index.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_PLAIN} AS leaf,
    CASE WHEN {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} % {TAMPER_EVERY} = 0 THEN {_CHANGED} ELSE {_PLAIN} END AS tampered
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT lang, 0 AS h, i, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT lang, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, h, i // 2, n
), subs AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS h, i, n, subroot AS digest FROM subs
  UNION ALL
  SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY h, i // 2, n
), steps AS (
  SELECT d.lang, d.i, t.h, t.digest, t.i < (d.i >> t.h) AS before FROM numbered d
  JOIN (SELECT * FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM d.lang AND t.i = xor(d.i >> t.h, 1)
  UNION ALL
  SELECT d.lang, d.i, 1000 + t.h, t.digest, t.i < (s.i >> t.h) FROM numbered d JOIN subs s ON s.lang IS NOT DISTINCT FROM d.lang
  JOIN (SELECT * FROM top WHERE n > 1) t ON t.i = xor(s.i >> t.h, 1)
), levels AS (
  SELECT d.lang, d.i, l.h FROM numbered d JOIN (SELECT DISTINCT lang, h FROM tree WHERE n > 1) l ON l.lang IS NOT DISTINCT FROM d.lang
  UNION ALL
  SELECT d.lang, d.i, 1000 + l.h FROM numbered d, (SELECT DISTINCT h FROM top WHERE n > 1) l
), path AS (
  SELECT l.lang, l.i, row_number() OVER (PARTITION BY l.lang, l.i ORDER BY l.h) AS k, s.digest, s.before
  FROM levels l LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM l.lang AND s.i = l.i AND s.h = l.h
), proof AS (
  SELECT lang, i, coalesce(string_agg(digest, '' ORDER BY k), '') AS joined FROM path GROUP BY lang, i
), folded AS (
  SELECT lang, i, 0 AS k, tampered AS digest FROM numbered
  UNION ALL
  SELECT f.lang, f.i, f.k + 1,
    sha256(CASE WHEN p.before THEN p.digest || f.digest ELSE f.digest || coalesce(p.digest, '') END)
  FROM folded f JOIN path p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i AND p.k = f.k + 1
), ends AS (
  SELECT lang, i, max_by(digest, k) AS folded_root FROM folded GROUP BY lang, i
)
SELECT d.doc_id, d.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.joined, '')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM numbered d JOIN subs s ON s.lang IS NOT DISTINCT FROM d.lang JOIN (SELECT digest FROM top WHERE n = 1) t ON true
JOIN ends e ON e.lang IS NOT DISTINCT FROM d.lang AND e.i = d.i LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM d.lang AND p.i = d.i
"""
