"""Near-duplicate groups by 64-bit SimHash fingerprints.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of four words joined by a space,
repeats included (fewer words: the whole sequence is one shingle; none: fingerprint zero); a bit is set
if it is set in more than half of the shingles' XXH64 (seed 42).

Candidates come from a segment-popcount embedding. The bits are cut into blocks, and a band is a pair of blocks: of
three blocks at least one pair holds at most two of four differing bits. A band is cut into segments of two
bits in two ways, one shifted by a bit, and its point has the bit count of each segment as coordinates.
Bit counts differ by no more than bits do, so half the Manhattan distance of two points is a lower bound of the
band's Hamming distance. Each distinct fingerprint is placed, for each band, on its own grid point and on all
grid points that one bit leads to: two points within two bits meet on a common one. The pairs that
meet are verified by their exact Hamming distance. A band has 42 bits or more, so that chance meetings stay few
next to the fingerprints however many there are (5e10 fingerprints: about eight each). Points are named by a linear
hash of their coordinates; points that share a name only cost time, as every pair is verified.

Groups are the connected components of the verified links. Only distinct fingerprints take part, so exact
copies, however many, are one node, and a grid point that many near copies share yields a spanning
forest of its links (found by breadth-first search over arrays of longs), never all pairs. The members of a point
with more than `CHUNK` of them are streamed out and dealt to chunks; every two chunks meet in a task of their
own, which yields a spanning forest, too. Components are
found by contraction: every node is merged into the least node it is linked to, links are rewritten
between the merged nodes, and the rounds go on until no link is left. Each round's tables are written to
the shared folder.

Similar shingle sets (`similar_documents`, the pipeline's stage): a similarity of 0.8 of two texts moves about ten of 64
bits, which no selective grid of 64 bits can reach. There a text has a longer fingerprint, 64 bits for each part of it: the distinct
hashes of its five-word shingles are cut into parts by their value, and each part has a SimHash fingerprint of its own (a bit is set if it
is set in more than half of the part's hashes; a text of few shingles is one part). Sets of m1 and m2 hashes with a Jaccard similarity of s
differ in at most (m1 + m2) (1 - s) / (1 + s) hashes. There are more parts than that, so the fingerprints of one part at least are equal,
whatever the others are: each part is a band of 64 bits, placed by the same embedding (segment bit counts in two cuts, named by the
linear hash) on its own grid point; neighbours aren't needed at distance zero. The number of parts belongs to a class of sizes; a set
is placed in its own class and, if a partner could be of the next, there too. Sets that meet on a point are candidates.
The Manhattan distance of the hash counts of two whole sets in 256 segments, a lower bound of the hashes they differ in, rejects most chance
meetings, and the Jaccard similarity of the rest is computed from the whole texts. Equal sets are one node. At a point of up to
`FEW` sets all pairs are candidates; at a greater one each set is first paired with the first only (within each batch before
the shuffle, too, so that a group that holds a third of all rows sends a row for each batch). Where the links found so far don't join all sets of such a
point, its sets are dealt to chunks that meet pairwise: every two sets of different groups are compared by their segment counts, and what the
bound does not reject is verified like the rest. No link is lost. That is quadratic only in points that many dissimilar sets share (a
template of which each page changes some 10 to 20 in a hundred words), with two small distances a pair and nothing emitted for pairs that are rejected.

Defined edge results: null, empty and blank texts have fingerprint zero, which links like any other (and equal, empty sets); rows that
repeat a doc_id are kept and each has its own fingerprint; a null doc_id is kept, and a group of nothing
but null doc_ids has a null component_id; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.runtime import stored

MAX_BITS = 4
SHINGLE = 4
SEED = 42
SEGMENT_BITS = 2
#: A grid point with more fingerprints than this is searched breadth first instead of pair by pair.
FEW = 16
#: A grid point with more fingerprints than this is searched by several tasks.
CHUNK = 4096
#: Documents whose points a task holds at a time, and texts (or pairs of them) whose sets it holds.
SLICE_ROWS, SLICE_TEXTS = 2500, 250
ROUNDS = 60
#: Words of a shingle and least Jaccard similarity of near duplicates, where no contract sets another rule.
SET_SHINGLE = 5
SIMILARITY = 0.8
#: Each class of set sizes ends at this multiple of the one before.
CLASS_RATIO = 1.75
#: Sets of so few hashes are dealt to parts several times, as a part of theirs is often empty.
SMALL_SET, SMALL_DEALS = 32, 4
#: Segments whose bit counts bound the distance of two candidates before their texts are fetched.
SEGMENTS = 256
#: Parts whose fingerprints are made and placed at a time.
PARTS_AT_ONCE = 1 << 13


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Shingles of a text, as UTF-8."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(size)))]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint."""
    parts = shingles(text, size)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(parts), step):  # whole texts, in pieces of bounded memory
        h = np.array([digest(p, SEED) for p in parts[at : at + step]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > len(parts)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": found.view(np.int64)})

    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.select(F.struct("doc_id").alias("doc_id"), "text")  # a struct keeps null keys out of float columns
    out = named.mapInPandas(compute, "doc_id struct<doc_id: bigint>, fp bigint")
    return out.select("doc_id.doc_id", "fp")


def bands(max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """The bits of each band; of two fingerprints within `max_bits` at least one band differs in two bits at most."""
    if max_bits <= 2:
        return [np.arange(64)]
    blocks = np.array_split(np.arange(64), 2 * max_bits // 3 + 1)
    return [np.concatenate(pair) for pair in combinations(blocks, 2)]


def grid_points(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(point, index of the fingerprint) of each placement of an array of u64 fingerprints; with `max_bits` 0 on their own points only."""
    points, owners, every = [], [], np.arange(len(fps))
    names = np.random.default_rng(64)
    for band in bands(max_bits):
        bits = np.stack([(fps >> np.uint64(b)) & np.uint64(1) for b in band])
        # Segment k of the first cut holds bits 2k and 2k + 1, of the second one bits 2k - 1 and 2k, round the band's end.
        places = np.arange(len(band)) // SEGMENT_BITS, (np.arange(len(band)) + 1) % len(band) // SEGMENT_BITS
        at, step = np.zeros(len(fps), np.uint64), np.zeros(len(band), np.uint64)
        for segment in places:
            name = names.integers(0, 1 << 64, segment.max() + 1, dtype=np.uint64)
            for k in range(len(name)):
                at += bits[segment == k].sum(axis=0, dtype=np.uint64) * name[k]
            step += name[segment]
        points.append(at)
        owners.append(every)
        for own, to in zip(bits, step) if max_bits else ():
            points.append(np.where(own == 0, at + to, at - to))
            owners.append(every)
    return np.concatenate(points).view(np.int64), np.concatenate(owners)


def links_within(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, breadth first; memory grows with their number only."""
    left, found = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found += [(int(x), int(y)) for y in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return found


def _meet(max_bits: int, chunk: int):
    """Rows (point, fp) that come sorted by point become links (a, b), or, at points of more than `chunk` rows, (fp, number at its point, point)."""

    def passed_on(fp: np.ndarray, first: int, point: int) -> pd.DataFrame:
        return pd.DataFrame({"a": fp.view(np.int64), "b": np.arange(first, first + len(fp)), "point": np.full(len(fp), point, object)})

    def search(point: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        sizes = np.diff(np.r_[starts, len(point)])
        found = []
        size_of = np.repeat(sizes, sizes)
        for shift in range(1, min(FEW, int(sizes.max()))):
            same = np.flatnonzero((point[shift:] == point[:-shift]) & (size_of[shift:] <= FEW))
            a, b = fp[same], fp[same + shift]
            near = np.bitwise_count(a ^ b) <= max_bits
            found.append(np.stack([a[near], b[near]], axis=1))
        for k in np.flatnonzero(sizes > FEW):
            here = fp[starts[k] : starts[k] + sizes[k]]
            if len(here) > chunk:
                yield passed_on(here, 0, int(point[starts[k]]))
                continue
            many = links_within(here, max_bits)
            if many:
                found.append(np.array(many, np.uint64))
        yield _signed(np.concatenate(found) if found else np.zeros((0, 2), np.uint64)).assign(point=None)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot, passed = None, 0  # the point that is being passed on, and how many of its rows were
        for batch in batches:
            point = np.concatenate([held[0], batch["point"].to_numpy()])
            fp = np.concatenate([held[1], batch["fp"].to_numpy().view(np.uint64)])
            held = point[:0], fp[:0]
            if len(point) and hot is not None and point[0] == hot:
                n = int(np.searchsorted(point, hot, "right"))
                yield passed_on(fp[:n], passed, hot)
                point, fp, passed = point[n:], fp[n:], passed + n
            if not len(point):
                continue
            hot, passed = None, 0
            cut = int(np.searchsorted(point, point[-1], "left"))  # the last point may go on in the next batch
            if cut:
                yield from search(point[:cut], fp[:cut])
            if len(point) - cut > chunk:
                hot, passed = int(point[-1]), len(point) - cut
                yield passed_on(fp[cut:], 0, hot)
            else:
                held = point[cut:], fp[cut:]
        if len(held[0]):
            yield from search(*held)

    return meet


def _signed(pairs: np.ndarray) -> pd.DataFrame:
    """Distinct links as signed longs, the lesser end first."""
    ends = np.sort(pairs.view(np.int64).reshape(-1, 2), axis=1)
    ends = np.unique(ends, axis=0) if len(ends) else ends
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): enough of the links among the distinct fingerprints `fp` to connect what is connected."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            point, owner = grid_points(fps, max_bits)
            yield pd.DataFrame({"point": point, "fp": fps[owner].view(np.int64)})

    placed = distinct.select("fp").mapInPandas(place, "point bigint, fp bigint")
    placed = placed.repartition("point").sortWithinPartitions("point")
    met = stored(placed.mapInPandas(_meet(max_bits, chunk), "a bigint, b bigint, point bigint"), "met")
    found = met.where("point is null").select("a", "b")
    hot = met.where("point is not null").select("point", F.col("a").alias("fp"), F.floor(F.col("b") / chunk).cast("int").alias("own"))
    if hot.isEmpty():
        return found.distinct()
    chunks = hot.groupBy("point").agg(F.max("own").alias("last"))
    pairs = hot.join(chunks, "point").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        many = links_within(pdf["fp"].to_numpy().view(np.uint64), max_bits)
        return _signed(np.array(many, np.uint64).reshape(-1, 2))

    pairs = pairs.select("point", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    more = pairs.groupBy("point", "i", "j").applyInPandas(forest, "a bigint, b bigint")
    return found.union(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); nodes of one component share a root.

    Contraction rounds: their number is logarithmic as node values are hashes. Aggregates combine on
    the map side; joins are between written tables, so a node with very many links can be split.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "links")
    mapping = None
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        step = stored(least.select(F.col("a").alias("node"), F.least("a", "least").alias("next")), "steps")
        if mapping is None:
            mapping = step.select("node", F.col("next").alias("root"))
        else:
            moved = mapping.join(step.withColumnsRenamed({"node": "root"}), "root", "left")
            mapping = stored(moved.select("node", F.coalesce("next", "root").alias("root")), "roots")
        left = edges.join(step.select(F.col("node").alias("a"), F.col("next").alias("x")), "a").select("x", "b")
        left = left.join(step.select(F.col("node").alias("b"), F.col("next").alias("y")), "b").where("x <> y")
        edges = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(edges, "links")
        if edges.isEmpty():
            return mapping
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def near_duplicates(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of `docs`."""
    marked = stored(fingerprints(docs, doc_key, text), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct, max_bits))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stored(joined.select("fp", F.coalesce("root", "fp").alias("root"), "first_id"), "rooted")
    firsts = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "first-ids")
    named = stored(rooted.join(firsts, "root").select("fp", "component_id"), "components")
    text_form = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", "fp", text_form.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int = SET_SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in ascending order."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in shingles(text, size)), np.uint64))


def segment_counts(hashes: np.ndarray) -> bytes:
    """How many hashes each of `SEGMENTS` equal segments holds; 255 stands for more, which only lowers distances."""
    segment = (hashes >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(segment, minlength=SEGMENTS), 255).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of u64 that spreads sums of hashes over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def set_parts(hashes: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in the order of their parts, where each part begins, the parts' names): two sets with a similarity of `least` or more have one in common."""
    m = len(hashes)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    level, top = 0, 4
    while top < m:
        level, top = level + 1, int(top * CLASS_RATIO)
    reached = [(level, top)]
    if m / least >= top:
        reached.append((level + 1, int(top * CLASS_RATIO)))
    members, starts, names = [], [], []
    for deal in range(SMALL_DEALS if m <= SMALL_SET else 1):
        dealt, own = hashes, hashes
        if deal:
            dealt = _mixed(hashes + np.uint64(deal))
            order = np.argsort(dealt)
            dealt, own = dealt[order], hashes[order]
        for level, top in reached:
            n_parts = int(2 * top * (1 - least) / (1 + least) + 1e-9) + 1
            part = ((dealt >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])  # what an empty part agrees on says nothing
            starts.append(first + m * len(members))
            names.append(part[first] + np.uint64(level * SMALL_DEALS + deal << 40))
            members.append(own)
    return np.concatenate(members), np.concatenate(starts), np.concatenate(names)


def part_fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each part, a run of `hashes` that begins at one of `starts`."""
    sizes = np.diff(np.append(starts, len(hashes)))
    found = [np.zeros(0, np.uint64)]
    for k in range(0, len(starts), PARTS_AT_ONCE):
        first, size = starts[k : k + PARTS_AT_ONCE], sizes[k : k + PARTS_AT_ONCE]
        bits = np.unpackbits(hashes[first[0] : first[-1] + size[-1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        order = np.argsort(-size, kind="stable")  # so that the parts that have a j-th hash come first
        first, size = first[order] - first[0], size[order]
        counts = bits[first].astype(np.uint16 if size[0] < 1 << 15 else np.int64)
        for j in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -j))
            counts[:n] += bits[first[:n] + j]
        fps = np.empty(len(first), np.uint64)
        fps[order] = np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        found.append(fps)
    return np.concatenate(found)


def points_of_sets(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(grid points of all sets, one after the other; how many each has)."""
    parts = [set_parts(s, least) for s in sets]
    before = np.cumsum([0] + [len(hashes) for hashes, _, _ in parts])
    starts = np.concatenate([first + n for (_, first, _), n in zip(parts, before)])
    fps = part_fingerprints(np.concatenate([hashes for hashes, _, _ in parts]), starts)
    own = _mixed(np.concatenate([names for _, _, names in parts]))
    at = [grid_points(fps[k : k + PARTS_AT_ONCE], 0)[0].view(np.uint64) for k in range(0, len(fps), PARTS_AT_ONCE)]
    points = np.concatenate(at) + own if at else own
    return _mixed(points).view(np.int64), np.array([len(first) for _, first, _ in parts])


def set_points(hashes: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The grid points of a sorted set: two sets with a similarity of `least` or more agree on one of them."""
    return points_of_sets([hashes], least)[0]


def _candidates(point: np.ndarray, node: np.ndarray, flagged: np.ndarray) -> pd.DataFrame:
    """Pairs of the rows, which come sorted by point: all at points of up to `FEW`, each with the first one at greater or flagged points,
    whose members are rows (node, point, hot), too."""
    starts = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
    sizes = np.diff(np.r_[starts, len(point)])
    size_of = np.repeat(sizes, sizes)
    hot = (size_of > FEW) | np.repeat(np.logical_or.reduceat(flagged, starts), sizes)
    found = [np.stack([np.repeat(node[starts], sizes)[hot], node[hot]], axis=1)]
    for shift in range(1, min(FEW, int(sizes.max()))):
        same = np.flatnonzero((point[shift:] == point[:-shift]) & (size_of[shift:] <= FEW))
        found.append(np.stack([node[same], node[same + shift]], axis=1))
    pairs = np.concatenate(found)
    return pd.concat([_signed(pairs[pairs[:, 0] != pairs[:, 1]]).assign(hot=False), _members(point[hot], node[hot])])


def _members(point: np.ndarray, node: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": node, "b": point, "hot": np.ones(len(node), bool)})


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(point, a, b) of three kinds, so that the many narrow rows are all that the shuffle writes: a member `a` of a point, b 0 (no hash is, in practice).

    Where a batch has more than `FEW` of a point's members, only the first is sent there, flagged by b = a, with links (a, b), at point b, of the others
    to it, and rows of all of them that name the hot point: a = point, b the hot point.
    """
    for batch in (b[k : k + SLICE_ROWS] for b in batches for k in range(0, len(b), SLICE_ROWS)):
        node = np.repeat(batch["node"].to_numpy(), batch["points"].map(len))
        if not len(node):
            continue
        points = np.concatenate(batch["points"].to_numpy())
        _, first, which, sizes = np.unique(points, return_index=True, return_inverse=True, return_counts=True)
        many = sizes[which] > FEW
        leads = first[which] == np.arange(len(node))
        sent = ~many | leads
        yield pd.DataFrame({"point": points[sent], "a": node[sent], "b": np.where(many[sent], node[sent], 0)})
        linked = _signed(np.stack([node[first][which], node], axis=1)[~sent])
        linked = linked[linked["a"] != linked["b"]]
        yield pd.DataFrame({"point": linked["b"], "a": linked["a"], "b": linked["b"]})  # under any point, so that they spread
        yield pd.DataFrame({"point": node[many], "a": node[many], "b": points[many]})


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of `_placed`, sorted by point, with their kind (0 member, 1 flagged member, 2 link, 3 member of a hot point), become candidates (a, b) and
    members of hot points (a = node, b = point, hot)."""
    held, lead = np.zeros((0, 3), np.int64), None  # rows (point, node, flag) of the last point, or its first row if it has many
    for batch in batches:
        point, a, kind = (batch[c].to_numpy() for c in ("point", "a", "kind"))
        other = batch["b"].to_numpy()
        for wanted, hot in ((2, False), (3, True)):
            at = kind == wanted
            yield pd.DataFrame({"a": a[at], "b": other[at], "hot": np.full(int(at.sum()), hot)})
        rows = np.concatenate([held, np.stack([point, a, kind], axis=1)[kind <= 1].astype(np.int64)])
        held = rows[:0]
        if lead is not None:
            n = int(np.searchsorted(rows[:, 0], lead[0], "right"))
            pairs = np.stack([np.full(n, lead[1]), rows[:n, 1]], axis=1)
            yield _signed(pairs[pairs[:, 0] != pairs[:, 1]]).assign(hot=False)
            yield _members(rows[:n, 0], rows[:n, 1])
            rows = rows[n:]
        if not len(rows):
            continue
        cut, lead = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left")), None
        if len(rows) - cut <= FEW:
            held, rows = rows[cut:], rows[:cut]
        else:
            lead = rows[cut]
        if len(rows):
            yield _candidates(rows[:, 0], rows[:, 1], rows[:, 2] > 0)
    if len(held):
        yield _candidates(held[:, 0], held[:, 1], held[:, 2] > 0)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of `SLICE_TEXTS` rows."""
    return (batch.slice(k, SLICE_TEXTS) for batch in batches for k in range(0, batch.num_rows, SLICE_TEXTS))


def marked_sets(batches: Iterator[pa.RecordBatch], size: int = SET_SHINGLE, least: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) with the text's shingle set named, counted and placed.

    Texts stay in Arrow's form but for a slice, as a batch of whole texts with their sets is what a worker can't hold.
    """
    for batch in sliced(batches):
        sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
        points, n = points_of_sets(sets, least)
        yield pa.RecordBatch.from_pydict({
            "key": batch["key"],
            "set": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            "size": pa.array([len(s) for s in sets], pa.int64()),
            "counts": pa.array([segment_counts(s) for s in sets], pa.binary()),
            "points": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(points, pa.int64())),
        })


def counts_within(a: pd.DataFrame, b: pd.DataFrame, least: float, rows: int = 16) -> np.ndarray:
    """Index pairs (into a, into b) of different roots whose segment counts leave a similarity of `least` possible.

    A coarse Manhattan distance, over sums of sixteen segments, is a lower bound of that over segments and rejects most first.
    """
    x, y = (np.frombuffer(b"".join(f["counts"]), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for f in (a, b))
    coarse_x, coarse_y = (z.reshape(len(z), 16, -1).sum(axis=2, dtype=np.int32) for z in (x, y))
    share, found = (1 - least) / (1 + least), [np.zeros((0, 2), np.int64)]
    sizes, roots = b["size"].to_numpy(), b["root"].to_numpy()
    for k in range(0, len(x), rows):
        at = slice(k, k + rows)
        most = (a["size"].to_numpy()[at, None] + sizes) * share + 1e-6
        near = (np.abs(coarse_x[at, None] - coarse_y).sum(axis=2) <= most) & (a["root"].to_numpy()[at, None] != roots)
        i, j = np.nonzero(near)
        close = np.abs(x[at][i] - y[j]).sum(axis=1) <= most[i, j]
        found.append(np.stack([i[close] + k, j[close]], axis=1))
    return np.concatenate(found)


def similar_documents(
    docs: DataFrame, doc_key: str = "doc_id", text: str = "text", size: int = SET_SHINGLE, least: float = SIMILARITY, chunk: int = CHUNK
) -> DataFrame:
    """(doc_id, text_hash, first): for every document of `docs`, a doc_id with a text, whether it is the first of those that links of sets of
    similarity `least` or more join with it, in order of doc_id (null first) and of text_hash, the xxhash64 of the text."""

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("counts_a", "counts_b"))
            at_most = (batch["size_a"] + batch["size_b"]).to_numpy() * (1 - least) / (1 + least) + 1e-6
            yield batch.loc[np.abs(a - b).sum(axis=1) <= at_most, ["a", "b"]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[str, np.ndarray]] = {}

        def of(side: str, text: str) -> np.ndarray:  # the last set of each side, as rows of one document are often neighbours
            if side not in kept or kept[side][0] != text:
                kept[side] = text, shingle_set(text, size)
            return kept[side][1]

        for batch in sliced(batches):
            texts = zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())
            near = [similarity(of("a", x), of("b", y)) >= least for x, y in texts]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = (pdf[pdf["own"] == k].reset_index(drop=True) for k in (i, j))
        near = counts_within(a, b, least)
        return _signed(np.stack([a["node"].to_numpy()[near[:, 0]], b["node"].to_numpy()[near[:, 1]]], axis=1))

    rows = document_keys(docs, doc_key, text)
    marked = stored(rows.mapInArrow(partial(marked_sets, size=size, least=least), f"key {KEY}, set binary, size bigint, counts binary, points array<bigint>"), "shingle-sets")
    node = F.xxhash64("key.doc_id", "key.text_hash")
    firsts = stored(marked.groupBy("set").agg(F.min("key").alias("first")), "distinct-sets")
    # Merge joins at every size, as both sides grow with the documents.
    joined = marked.select("set", "key").join(firsts.hint("merge"), "set").where("key <> first")
    copies = joined.select(F.xxhash64("first.doc_id", "first.text_hash").alias("a"), node.alias("b")).where("a <> b")
    nodes = marked.join(firsts.withColumnRenamed("first", "key").hint("merge"), ["set", "key"], "left_semi")
    placed = nodes.select(node.alias("node"), "points").mapInPandas(_placed, "point bigint, a bigint, b bigint")
    # The first member of a large point is the least at one half of the points and the greatest at the other.
    placed = placed.repartition("point").sortWithinPartitions("point", F.expr("if(point % 2 = 0, a, ~a)"))
    kind = F.when(F.col("b") == 0, 0).when(F.col("a") == F.col("b"), 1).when(F.col("a") != F.col("point"), 2).otherwise(3).cast("long")
    placed = placed.select("point", "a", "b", kind.alias("kind"))
    met = stored(placed.mapInPandas(_met, "a bigint, b bigint, hot boolean"), "met-sets")
    pairs = stored(met.where("not hot").select("a", "b").distinct(), "candidate-pairs")

    def both_sides(pairs: DataFrame, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
        """`pairs` with `columns` of either side; only rows of nodes in pairs are sorted by what they hold."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        own = stored(rows.join(nodes.hint("merge"), "node", "left_semi").distinct(), name)
        for side in ("a", "b"):
            named = own.withColumnsRenamed({"node": side} | {c: f"{c}_{side}" for c in columns})
            pairs = pairs.join(named.hint("merge"), side)
        return pairs

    counts = marked.select(node.alias("node"), "size", "counts").distinct()
    near = both_sides(pairs, counts, ["size", "counts"], "candidate-counts").mapInPandas(bounded, "a bigint, b bigint")
    near = stored(near.distinct(), "near-pairs")
    texts = rows.select(node.alias("node"), "text")
    links_found = both_sides(near, texts, ["text"], "candidate-texts").mapInArrow(verify, "a bigint, b bigint")
    links_found = stored(links_found.union(copies).distinct(), "set-links")
    roots = components(links_found)

    # Points of many sets: where links through their first members haven't joined all of them, the rest is compared chunk by chunk.
    members = met.where("hot").select(F.col("a").alias("node"), F.col("b").alias("point")).distinct()
    members = members.join(roots.hint("merge"), "node", "left").select("point", "node", F.coalesce("root", "node").alias("root"))
    members = stored(members, "members-of-hot-points")
    left = members.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    left = stored(left.select("point", F.ceil(F.col("n") / chunk).cast("int").alias("n_chunks")), "open-points")
    if not left.isEmpty():
        open_rows = stored(members.join(left, "point"), "members-of-open-points")
        own = stored(counts.join(open_rows.select("node").distinct(), "node", "left_semi"), "counts-of-members")
        dealt = open_rows.join(own.hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        dealt = dealt.select("point", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "size", "counts")
        more = dealt.groupBy("point", "i", "j").applyInPandas(compare, "a bigint, b bigint")
        more = stored(more.distinct().join(near.hint("merge"), ["a", "b"], "left_anti"), "pairs-at-open-points")
        found = both_sides(more, texts, ["text"], "texts-at-open-points").mapInArrow(verify, "a bigint, b bigint")
        found = stored(found.distinct(), "links-at-open-points")
        if not found.isEmpty():
            roots = components(links_found.union(found).distinct())

    ids = marked.select("key", node.alias("node")).distinct().join(roots.hint("merge"), "node", "left")
    rooted = stored(ids.select("key", F.coalesce("root", "node").alias("root")), "rooted-ids")
    first_keys = stored(rooted.groupBy("root").agg(F.min("key").alias("first")), "first-ids")
    found = rooted.join(first_keys.hint("merge"), "root")
    return found.select("key.doc_id", "key.text_hash", (F.col("key") == F.col("first")).alias("first"), F.col("first.doc_id").alias("component_id"))


#: Names a document: a doc_id, NO_ID for a null one, and its text's hash.
KEY = "struct<doc_id: bigint, text_hash: bigint>"
NO_ID = -(1 << 63)


def document_keys(docs: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of every row; a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(F.coalesce(F.col(doc_key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(whole).alias("text_hash")).alias("key"), whole.alias("text"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of similar texts (`similar_documents`), that of its first document; columns as they are.

    A doc_id with different texts is as many documents; of rows with equal doc_id and text one stays.
    """
    found = similar_documents(docs)
    # What goes is far less than what stays, so the texts meet the smaller set.
    gone = stored(found.where("not first").select("doc_id", "text_hash"), "documents-gone")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    row = row.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("h", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    left = row.join(gone, (F.col("d") == F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_anti")
    again = stored(document_keys(docs).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key.*"), "repeated-documents")
    if again.isEmpty():
        return left.select("row.*")
    same = (F.col("d") == F.col("doc_id")) & (F.col("h") == F.col("text_hash"))
    once = left.join(again, same, "left_anti").select("row")
    repeated = left.join(again, same, "left_semi").groupBy("d", "h").agg(F.min("row").alias("row")).select("row")
    return once.union(repeated).select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and near-duplicate group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
