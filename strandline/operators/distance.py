"""Distances between cells in blocks: vectors meet block by block, and only what is asked for leaves a task.

`vec` is (cell_id, pos, features) with pos counting from 1. All-pairs arithmetic is quadratic by
nature; a distance matrix of two blocks of `block` vectors is the most that a task makes at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.runtime import stored

METRICS = ("Euclidean", "Correlation", "eJaccard")
BLOCK = 1024


def block_distance(a: np.ndarray, b: np.ndarray, method: str = "Euclidean") -> np.ndarray:
    """(rows of a, rows of b) distances: Euclidean, 1 - Pearson correlation, or 1 - extended Jaccard similarity."""
    if method == "Correlation":
        def standard(x: np.ndarray) -> np.ndarray:
            c = x - x.mean(axis=1, keepdims=True)
            norm = np.sqrt((c**2).sum(axis=1, keepdims=True))
            return np.divide(c, norm, out=np.zeros_like(c), where=norm > 0)

        return 1.0 - standard(a) @ standard(b).T
    inner = a @ b.T
    left, right = (a**2).sum(axis=1)[:, None], (b**2).sum(axis=1)[None, :]
    if method == "Euclidean":
        # In place: left - 2 * inner + right.
        inner *= -2
        inner += left
        inner += right
        return np.sqrt(np.abs(inner, out=inner), out=inner)
    if method == "eJaccard":
        either = left + right - inner
        return 1.0 - np.divide(inner, either, out=np.ones_like(inner), where=either != 0)
    raise ValueError(f"unknown distance {method}")


def same_is_zero(d: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """Distances with exact zeros where a cell meets itself."""
    return np.where(pos_a[:, None] == pos_b[None, :], 0.0, d)


#: Doubles of the vectors of a tile (128 MB); a task holds two tiles.
TILE_NUMBERS = 16_000_000
#: Cells with a number each that are sent to all tasks (about 100 bytes a cell there).
BROADCAST_CELLS = 1_000_000
#: Rows of a block whose distances leave a task in one batch.
PAIR_ROWS = 64
#: Rows of partial results that a task gathers before it folds them.
FOLD_ROWS = 200_000


def tiles_of(n_blocks: int, block: int, width: int, parallelism: int) -> int:
    """Into how many tiles the blocks are put: as few as fit a task's memory and keep all tasks busy, so a vector is sent
    that many times, not once for each block."""
    fit = math.ceil(n_blocks * block * max(1, width) / TILE_NUMBERS)
    return min(n_blocks, max(fit, math.ceil(math.sqrt(2 * parallelism))))


def summed_by(*keys: str) -> Callable:
    """A fold for `block_pairs` that adds up the other columns by `keys`."""
    return lambda rows: rows.groupby(list(keys), as_index=False, sort=False).sum()


def block_pairs(
    vec: DataFrame, fn: Callable, schema: str, block: int = BLOCK, extra: list[str] | None = None, method="Euclidean", zero_self: bool = True,
    fold: Callable | None = None, tiles: int | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Apply `fn(a, b, d)` to each pair of blocks a <= b: frames of the blocks' rows and their distances.

    `method` is a name or a function of two arrays of vectors; a cell's own entry is 0 unless `zero_self` is off.
    With `fold`, which makes fewer rows of the results of several pairs, blocks travel in tiles (`tiles_of`): a task gets two tiles, lets their blocks
    meet and sends what is left after folding, so the shuffle grows with the cells, not with their square. Without it each block goes to
    each of its pairs, by key, as the results are the pairs themselves.
    With `keys` only cells of the same keys meet: `pos` counts within them, the column `size` holds their number of cells, and `schema` begins with the keys,
    which are added to what `fn` and `fold` return.
    """
    keys = keys or []
    measure = method if callable(method) else lambda x, y: block_distance(x, y, method)
    about = vec.agg(F.max("pos").alias("last"), F.max(F.size("features")).alias("width")).first()
    n = max(1, math.ceil((about["last"] or 0) / block))
    if fold is None:
        tiles = n
    elif tiles is None:
        tiles = tiles_of(n, block, about["width"] or 1, vec.sparkSession.sparkContext.defaultParallelism)
    blocks = math.ceil(n / tiles)
    own = F.floor((F.col("pos") - 1) / (block * blocks)).cast("int")
    last = F.floor((F.col("size") - 1) / (block * blocks)).cast("int") if keys else F.lit(math.ceil(n / blocks) - 1)
    columns = [*keys, "cell_id", "pos", "features", *(extra or [])]
    rows = vec.select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return fn(a.iloc[:0], b.iloc[:0], np.zeros((0, 0)))
        d = measure(np.stack(a["features"].to_numpy()), np.stack(b["features"].to_numpy()))
        return fn(a, b, same_is_zero(d, a["pos"].to_numpy(), b["pos"].to_numpy()) if zero_self else d)

    def with_keys(pdf: pd.DataFrame) -> pd.DataFrame:
        return met(pdf).assign(**{k: pdf[k].iloc[0] for k in keys})

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["own"] == pdf["a"].iloc[0]].sort_values("pos")
        b = pdf[pdf["own"] == pdf["b"].iloc[0]].sort_values("pos")
        if fold is None:
            return pair(a, b)
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        left, right = ([x for _, x in f.groupby((f["pos"] - 1) // block)] for f in (a, b))
        found, size = [], 0
        for i, x in enumerate(left):
            for y in right[i if same else 0 :]:
                found.append(pair(x, y))
                size += len(found[-1])
                if size > FOLD_ROWS:
                    found = [fold(pd.concat(found))]
                    size = len(found[0])
        return fold(pd.concat(found)) if found else pair(a, b)

    return rows.groupBy(*keys, "a", "b").applyInPandas(with_keys if keys else met, schema)


@dataclass
class Tile:
    """Cells of a tile in order of pos: Arrow strings, places, vectors, and the numbers of another column."""

    cell_id: pa.Array
    pos: np.ndarray
    features: np.ndarray
    extra: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.pos)


def tile_of(batches: list[pa.RecordBatch], column: str, value: int | bool, width: int, extra: bool = False) -> Tile:
    """The cells of the batches (cell_id, pos, features of `width`, extra) whose `column` has the value."""
    kept = [x for x in (batch.filter(pc.equal(batch[column], value)) for batch in batches) if len(x)]
    if not kept:
        return Tile(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros((0, width)), np.zeros(0))
    pos = np.concatenate([x["pos"].to_numpy() for x in kept])
    order = np.argsort(pos, kind="stable")
    features = np.concatenate([x["features"].flatten().to_numpy(zero_copy_only=False) for x in kept]).reshape(len(pos), -1)[order]
    names = pa.concat_arrays([x["cell_id"] for x in kept]).take(pa.array(order))
    return Tile(names, pos[order], features, np.concatenate([x["extra"].to_numpy(zero_copy_only=False) for x in kept])[order] if extra else None)


#: Tile pairs for each task at once, so that tasks of unlike size even out; a vector is sent about sqrt(2 * this * tasks) times.
SPREAD = 4


def tile_pairs(vec: DataFrame, fn: Callable, schema: str, block: int = BLOCK, extra: str | None = None) -> DataFrame:
    """What the generator `fn(a, b)` of record batches yields for each pair of tiles a <= b of `vec`, `b` being `a` itself where a tile meets itself.

    Like `block_pairs` with a fold, but batches leave a task as they are made: the shuffle grows with the cells and a task holds two tiles and a batch,
    even where the results are the pairs themselves. `extra` names a column of numbers.
    """
    about = vec.agg(F.max("pos").alias("last"), F.max(F.size("features")).alias("width")).first()
    width = about["width"] or 0
    n = max(1, math.ceil((about["last"] or 0) / block))
    tiles = tiles_of(n, block, width, SPREAD * vec.sparkSession.sparkContext.defaultParallelism)
    size = block * math.ceil(n / tiles)
    own = F.floor((F.col("pos") - 1) / size).cast("int")
    more = [F.col(extra).cast("double").alias("extra")] if extra else []
    rows = vec.select("cell_id", F.col("pos").cast("long").alias("pos"), "features", *more, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(math.ceil(n * block / size) - 1))).alias("other"))
    rows = rows.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        first, last = held[0]["a"][0].as_py(), held[0]["b"][0].as_py()
        a = tile_of(held, "own", first, width, bool(extra))
        b = a if first == last else tile_of(held, "own", last, width, bool(extra))
        del held
        yield from fn(a, b)

    return rows.groupBy("a", "b").applyInArrow(met, schema)


def _is_diagonal(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return len(a) > 0 and len(b) > 0 and a["pos"].iloc[0] == b["pos"].iloc[0]


def pairwise_distance(vec: DataFrame, method="Euclidean", block: int = BLOCK) -> DataFrame:
    """dist(i, j, d) of all pairs i < j; `method` 'none' passes a supplied dist table through."""
    if method == "none":
        return vec.select("i", "j", "d")

    measure = method if callable(method) else lambda x, y: block_distance(x, y, method)

    def pairs(a: Tile, b: Tile) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), block):
            for j in range(i if a is b else 0, len(b), block):
                d = measure(a.features[i : i + block], b.features[j : j + block])
                for at in range(0, len(d), PAIR_ROWS):
                    part = d[at : at + PAIR_ROWS]
                    if a is b and i == j:
                        x, y = np.triu_indices(len(part), at + 1, d.shape[1])
                    else:
                        x, y = (k.ravel() for k in np.indices(part.shape))
                    columns = [a.cell_id.take(pa.array(x + i + at)), b.cell_id.take(pa.array(y + j)), pa.array(part[x, y])]
                    yield pa.record_batch(columns, names=["i", "j", "d"])

    return tile_pairs(vec, pairs, "i string, j string, d double", block)


def by_rank(vec: DataFrame, ordering: DataFrame) -> DataFrame:
    """vec with pos taken from an ordering."""
    return vec.drop("pos").join(ordering.select("cell_id", F.col("rank").alias("pos")), "cell_id").select("cell_id", "pos", "features")


def weighted_sums(vec: DataFrame, weight: str, method="Euclidean", block: int = BLOCK) -> DataFrame:
    """(cell_id, s): s = sum over all cells j of d(i, j) * weight_j; a task sends one number for each of its cells."""

    def partial(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        left = pd.DataFrame({"cell_id": a["cell_id"].to_numpy(), "s": d @ b[weight].to_numpy(dtype=float)})
        if _is_diagonal(a, b):
            return left
        right = pd.DataFrame({"cell_id": b["cell_id"].to_numpy(), "s": d.T @ a[weight].to_numpy(dtype=float)})
        return pd.concat([left, right])

    found = block_pairs(vec, partial, "cell_id string, s double", block, [weight], method, fold=summed_by("cell_id"))
    return found.groupBy("cell_id").agg(F.sum("s").alias("s"))


def _summed_arrays(rows: pd.DataFrame) -> pd.DataFrame:
    codes, cells = pd.factorize(rows["cell_id"])
    s = np.stack(rows["s"].to_numpy()) if len(rows) else np.zeros((0, 0))
    total = np.zeros((len(cells), s.shape[1]))
    np.add.at(total, codes, s)
    return pd.DataFrame({"cell_id": cells, "s": list(total)})


def weighted_sums_of_each(vec: DataFrame, keys: list[str], weights: str, method="Euclidean", block: int = BLOCK) -> DataFrame:
    """(keys..., cell_id, at, s): `weighted_sums` for each entry `at` of the array `weights`, among the cells of the same keys.

    Distances are taken once for all entries. `vec` is (keys..., size, cell_id, pos, features, weights), see `block_pairs`.
    """

    def partial(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        if not d.size:
            return pd.DataFrame({"cell_id": pd.Series([], dtype=object), "s": pd.Series([], dtype=object)})
        left = pd.DataFrame({"cell_id": a["cell_id"].to_numpy(), "s": list(d @ np.stack(b[weights].to_numpy()))})
        if _is_diagonal(a, b):
            return left
        right = pd.DataFrame({"cell_id": b["cell_id"].to_numpy(), "s": list(d.T @ np.stack(a[weights].to_numpy()))})
        return pd.concat([left, right])

    types = dict(vec.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "cell_id string, s array<double>"])
    found = block_pairs(vec, partial, schema, block, [weights], method, fold=_summed_arrays, keys=keys)
    each = found.select(*keys, "cell_id", F.posexplode("s").alias("at", "s"))
    return each.groupBy(*keys, "cell_id", "at").agg(F.sum("s").alias("s"))


def centroids_of(vec: DataFrame, count: int, seed: int = 1) -> np.ndarray:
    """(count, features) centres of a k-means on the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=count, seed=seed, maxIter=10).fit(vec.select(array_to_vector("features").alias("features")))
    return np.array(model.clusterCenters())


def with_nearest_centroids(vec: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """vec with `lists`: the numbers of its nearest centres (a fixed number of centres, broadcast), nearest first."""
    shared = vec.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        d = block_distance(np.stack(features.to_numpy()), shared.value)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)), dtype=object)

    return vec.withColumn("lists", nearest("features"))


def weighted_sums_by_centroids(vec: DataFrame, weight: str, centres: np.ndarray) -> DataFrame:
    """(cell_id, s): `weighted_sums` with each cell j replaced by its nearest centre; linear in the number of cells."""
    listed = with_nearest_centroids(vec, centres).withColumn("list", F.col("lists")[0])
    sums = {r["list"]: r["x"] for r in listed.groupBy("list").agg(F.sum(weight).alias("x")).collect()}
    shared = vec.sparkSession.sparkContext.broadcast((centres, np.array([sums.get(i, 0.0) for i in range(len(centres))])))

    @F.pandas_udf("double")
    def total(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype="float64")
        points, x = shared.value
        return pd.Series(block_distance(np.stack(features.to_numpy()), points) @ x)

    return vec.select("cell_id", total("features").alias("s"))


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"c": [rows["c"].sum()]})


def _beside_pairs(cells: DataFrame) -> DataFrame:
    """`cells` to be joined with a table of pairs: sent to all tasks if they are few, as pairs are many times as many; counted first."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def weighted_sums_of_pairs(vec: DataFrame, weight: str, pairs: DataFrame) -> DataFrame:
    """(cell_id, s): the sums of `weighted_sums` over a supplied table pairs(i, j, d) that holds each pair once, either way round.

    Absent pairs have distance 0. Pairs are read once, stay where they are and count for both cells; sums combine on the map side, so what is
    shuffled by cell grows with the cells of a task.
    """
    cells = stored(vec.select("cell_id", F.col(weight).cast("double").alias("x")), "weights")
    sides = [_beside_pairs(cells.select(F.col("cell_id").alias(side), F.col("x").alias(f"x_{side}"))) for side in ("i", "j")]
    met = pairs.select("i", "j", "d").where("i <> j").join(sides[0], "i").join(sides[1], "j")
    both = F.array(*[F.struct(F.col(a).alias("cell_id"), (F.col("d") * F.col(f"x_{b}")).alias("s")) for a, b in (("i", "j"), ("j", "i"))])
    sums = met.select(F.explode(both).alias("e")).groupBy("e.cell_id").agg(F.sum("e.s").alias("s"))
    return vec.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("s", F.lit(0.0)).alias("s"))


def sts_cost_of_pairs(pairs: DataFrame, ordering: DataFrame) -> DataFrame:
    """(cost): `sts_cost` of ordering(cell_id, rank) by supplied distances."""
    n = ordering.agg(F.max("rank")).first()[0] or 0
    x = F.col("rank") - (n + 1) / 2
    cells = stored(ordering.select("cell_id", x.alias("x")), "weights")
    sides = [_beside_pairs(cells.select(F.col("cell_id").alias(side), F.col("x").alias(f"x_{side}"))) for side in ("i", "j")]
    met = pairs.where("i <> j").join(sides[0], "i").join(sides[1], "j")
    # By cell first: adding all products to one number would lose its last digits.
    each = met.groupBy("i", "x_i").agg(F.sum(F.col("d") * F.col("x_j")).alias("s"))
    return each.agg(F.coalesce(F.sum(F.col("s") * F.col("x_i") * 2), F.lit(0.0)).alias("cost"))


def sts_cost(vec: DataFrame, method="Euclidean", block: int = BLOCK) -> DataFrame:
    """(cost): sum of d(i, j) x_i x_j with x = pos - (n + 1) / 2; pairs are never kept."""
    n = vec.agg(F.max("pos")).first()[0] or 0

    def partial(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        x, y = (f["pos"].to_numpy() - (n + 1) / 2 for f in (a, b))
        return pd.DataFrame({"c": [float(x @ d @ y) * (1 if _is_diagonal(a, b) else 2) if d.size else 0.0]})

    return block_pairs(vec, partial, "c double", block, method=method, fold=_total).agg(F.sum("c").alias("cost"))


class Weights:
    """The weights exp(-(i - j)^2 / (sigma n)), normalised by columns and rows in turn and made symmetric.

    Normalising only scales rows and columns, so two numbers for each cell say everything, and any part of the
    matrix is made where it is needed. Weights further than `reach` from the diagonal are below 1e-15.
    """

    def __init__(self, n: int, sigma: float = 1.0, rounds: int = 10):
        self.n, self.width = n, sigma * n
        self.reach = min(max(n - 1, 0), math.ceil(math.sqrt(36 * sigma * n)))
        size = 1 << (n + 2 * self.reach).bit_length()
        kernel = np.zeros(size)
        offset = np.arange(-self.reach, self.reach + 1)
        kernel[offset] = np.exp(-(offset**2) / self.width)  # negative offsets wrap round
        image = np.fft.rfft(kernel)

        def spread(x: np.ndarray) -> np.ndarray:
            return np.fft.irfft(np.fft.rfft(x, size) * image, size)[:n]

        self.row, self.column = np.ones(n), np.ones(n)
        for _ in range(rounds):
            self.column = 1 / spread(self.row)
            self.row = 1 / spread(self.column)

    def part(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The given rows and columns (from 0)."""
        gap = rows[:, None] - columns[None, :]
        near = np.where(np.abs(gap) <= self.reach, np.exp(-(gap.astype(float) ** 2) / self.width), 0.0)
        scales = np.outer(self.row[rows], self.column[columns]) + np.outer(self.column[rows], self.row[columns])
        return near * scales / 2


@functools.lru_cache(maxsize=4)
def weights_of(n: int, sigma: float = 1.0) -> Weights:
    """`Weights`, made where they are needed and kept by each Python worker: nothing of the length of the order is broadcast."""
    return Weights(n, sigma)


def neighbourhood_cost(
    vec: DataFrame, sigma: float = 1.0, method="Euclidean", form: str = "reported", block: int = BLOCK, keys: list[str] | None = None
) -> DataFrame:
    """(keys..., cost): trace of D W W^T ('reported') or of D W ('internal', the cost that the sort lowers); `keys` as in `block_pairs`."""
    keys = keys or []
    if not keys:
        vec = vec.withColumn("size", F.lit(vec.agg(F.max("pos")).first()[0] or 0).cast("long"))

    def partial(x: pd.DataFrame, y: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        if not d.size:
            return pd.DataFrame({"c": [0.0]})
        n = int(x["size"].iloc[0])
        w = weights_of(n, sigma)
        i, j = x["pos"].to_numpy() - 1, y["pos"].to_numpy() - 1
        if form == "internal":
            near = w.part(i, j)
        else:
            low, high = max(0, max(i.min(), j.min()) - w.reach), min(n - 1, min(i.max(), j.max()) + w.reach)
            near = np.zeros(d.shape)
            for at in range(low, high + 1, block):
                both = np.arange(at, min(high + 1, at + block))
                near += w.part(i, both) @ w.part(j, both).T
        return pd.DataFrame({"c": [float((d * near).sum()) * (1 if _is_diagonal(x, y) else 2)]})

    types = dict(vec.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "c double"])
    found = block_pairs(vec, partial, schema, block, ["size"], method, fold=_total, keys=keys)
    return found.groupBy(*keys).agg(F.sum("c").alias("cost"))


def distance_grid(vec: DataFrame, grid: int = 10, method="Euclidean", block: int = BLOCK) -> DataFrame:
    """(row, column, mean_distance): mean distance between the cells of rank buckets, `grid` buckets along the order."""
    n = vec.agg(F.max("pos")).first()[0] or 0

    def partial(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        x, y = ((f["pos"].to_numpy() - 1) * grid // max(n, 1) for f in (a, b))
        cell = (x[:, None] * grid + y[None, :]).ravel()
        sums = np.bincount(cell, weights=d.ravel(), minlength=grid * grid)
        counts = np.bincount(cell, minlength=grid * grid)
        row, column = np.divmod(np.arange(grid * grid), grid)
        out = pd.DataFrame({"row": row, "column": column, "s": sums, "n": counts})
        if not _is_diagonal(a, b):
            out = pd.concat([out, out.rename(columns={"row": "column", "column": "row"})])
        return out[out["n"] > 0]

    summed = block_pairs(vec, partial, "row int, column int, s double, n bigint", block, method=method, fold=summed_by("row", "column"))
    return summed.groupBy("row", "column").agg((F.sum("s") / F.sum("n")).alias("mean_distance"))


def half_window(n: int, alpha: float) -> int:
    return int(math.ceil(n * alpha) / 2)


def _windows(i: np.ndarray, n: int, h: int, cyclic: bool, exclusion: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, left out) position of the window of each centre i (from 1), on a line that goes on after n if cyclic; 0: none left out."""
    if cyclic:
        low = np.where(i - h < 1, n - i, n + i) if exclusion == "positional" else n + i - h
        high, own = n + i + h, n + i
    else:
        low, high, own = np.maximum(1, i - h), np.minimum(n, i + h), i
    out = low + i - 1 if exclusion == "positional" else own
    return low, high, np.where((out >= low) & (out <= high), out, 0)


def _partners(n: int, h: int, block: int, cyclic: bool, exclusion: str) -> Callable:
    """Rows (own, other): the blocks that the windows of each block's centres reach."""
    blocks = max(1, math.ceil(n / block))

    def reached(batches):
        for batch in batches:
            for own in batch["id"]:
                i = np.arange(own * block + 1, min(n, (own + 1) * block) + 1)
                low, high, _ = _windows(i, n, h, cyclic, exclusion)
                places = np.arange(low.min(), high.max() + 1, 1)
                found = np.unique((places - 1) % n // block) if len(places) < n else np.arange(blocks)
                yield pd.DataFrame({"own": np.full(len(found), own, np.int32), "other": found.astype(np.int32)})

    return reached


def local_variance(
    vec: DataFrame, alpha: float = 0.3, data_type: str = "linear", method="Euclidean", exclusion: str = "positional", keys: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """(keys..., local_variance): for each centre the variance of its distances to the cells within half a window, summed.

    A range join on rank in blocks: a task holds two blocks and gives, for each centre, the number, sum and sum of squares of the
    distances in its window, which are added up over the blocks. By default the
    window's element with the centre's own number is left out, and the cyclic window is that of the method's definition;
    `exclusion='self'` leaves out the centre and takes a symmetric window. `keys` separates several orderings of the
    same number of cells.
    """
    keys = keys or []
    spark = vec.sparkSession
    n = vec.agg(F.max("pos")).first()[0] or 0
    h, cyclic = half_window(n, alpha), data_type == "cyclical"
    pairs = spark.range(max(1, math.ceil(n / block))).mapInPandas(_partners(n, h, block, cyclic, exclusion), "own int, other int")
    rows = vec.select(*keys, "pos", "features", F.floor((F.col("pos") - 1) / block).cast("int").alias("at"))
    centres = rows.join(pairs.withColumn("at", F.col("own")), "at").withColumn("asks", F.lit(True))
    around = rows.join(pairs.withColumn("at", F.col("other")), "at").withColumn("asks", F.lit(False))
    measure = method if callable(method) else lambda x, y: block_distance(x, y, method)
    first, last = (1, n) if cyclic else (max(1, h), n - h)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"] & pdf["pos"].between(first, last)], pdf[~pdf["asks"]]
        i, p = a["pos"].to_numpy(), b["pos"].to_numpy()
        out = {k: np.full(len(i), pdf[k].iloc[0]) for k in keys} | {"pos": i}
        if not len(i) or not len(p):
            return pd.DataFrame(out | {"k": np.zeros(len(i)), "s": np.zeros(len(i)), "q": np.zeros(len(i))})
        d = same_is_zero(measure(np.stack(a["features"].to_numpy()), np.stack(b["features"].to_numpy())), i, p)
        low, high, gone = (x[:, None] for x in _windows(i, n, h, cyclic, exclusion))
        times = np.zeros(d.shape)
        for turn in range(3 if cyclic else 1):
            place = p[None, :] + turn * n
            times += (place >= low) & (place <= high) & (place != gone)
        return pd.DataFrame(out | {"k": times.sum(axis=1), "s": (times * d).sum(axis=1), "q": (times * d * d).sum(axis=1)})

    types = dict(vec.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "pos long, k double, s double, q double"])
    found = centres.unionByName(around).groupBy(*keys, "own", "other").applyInPandas(sums, schema)
    each = found.groupBy(*keys, "pos").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = F.when(F.col("k") > 1, F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("k"), F.lit(0.0)) / (F.col("k") - 1)).otherwise(F.lit(float("nan")))
    return each.groupBy(*keys).agg(F.sum(variance).alias("local_variance"))
