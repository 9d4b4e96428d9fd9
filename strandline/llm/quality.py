"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words (lower-cased, hashed to `2**WORD_BITS` places, weight
1 + log(count), scaled to unit length), statistics of its structure (shares of kinds of characters, word and
line lengths, repetition; see `STATS`) and the metadata column `n_chars`. The score is the logistic
function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

whose pairwise part is computed in linear time as 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

It is fitted (AdaGrad on the log loss) on at most about `sample_docs` labelled rows, chosen by a hash of
doc_id among those whose crc32(doc_id as text) mod 4 is not 2; only their sparse features reach the
driver. Labels, lang, source and doc_id are never inputs of a score. Scoring reads whole texts, batch by
batch, with the model broadcast (a fixed number of parameters).

Defined edge results: null and empty texts have no words and zero statistics, and are scored like any other
text; a null n_chars is taken as the text's length; without any label every score is 0.5; rows with a
null doc_id are held out and scored; of several labels of one doc_id the least counts, of several rows of one doc_id
the least text is learnt from; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BITS = 15
FACTORS = 6
SAMPLE_DOCS = 6000
THRESHOLD = 0.7
EPOCHS = 12
CACHE_WORDS = 200_000
#: Kinds of bytes whose shares are statistics: lower case, upper case, digits, blanks, line ends, stops, other signs, non-ASCII.
KINDS = 8
STATS = KINDS + 8
N_WORDS = 1 << WORD_BITS

_KIND = np.full(256, 6, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 32]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in ".,;:?'"]] = 5
_KIND[128:] = 7
_PLACES: dict[str, int] = {}


def _place(word: str) -> int:
    if len(_PLACES) >= CACHE_WORDS:
        _PLACES.clear()
    found = _PLACES[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (N_WORDS - 1) | N_WORDS
    return found


def features(text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): statistics first (places 0..STATS-1), then hashed words."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(_KIND[raw], minlength=KINDS) / max(1, len(raw))
    words = text.lower().split()
    known = _PLACES
    hashed = np.array([known.get(w) or _place(w) for w in words], np.int64) - N_WORDS
    places, counts = np.unique(hashed, return_counts=True)
    n, lines = len(words), text.split("\n")
    length = len(text) if n_chars is None or n_chars != n_chars else n_chars
    stats = np.array([
        *shares,
        np.log1p(n) / 10,
        np.log1p(max(0.0, length)) / 12,
        len(text) / max(1, n) / 20,
        len(places) / max(1, n),
        counts.max() / n if n else 0.0,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 8,
        text.count(".") / max(1, n),
    ]) * bool(text)
    weight = 1 + np.log(counts)
    weight /= max(1e-9, np.sqrt((weight**2).sum()))
    return np.concatenate([np.arange(STATS), places + STATS]), np.concatenate([stats, weight]).astype(np.float32)


@dataclass
class Machine:
    """bias, weights (places) and factors (places, FACTORS); statistics are standardised by mean and scale."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, values: np.ndarray) -> np.ndarray:
        out = values.astype(np.float64)
        out[:STATS] = np.clip((out[:STATS] - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)
        return out

    def raw_score(self, places: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[places]
        total = x @ v
        return self.bias + self.weights[places] @ x + 0.5 * float((total**2).sum() - (x**2 @ v**2).sum())


def score_text(machine: Machine | None, text: str | None, n_chars: float | None = None) -> float:
    """The probability that the text is of quality 1."""
    if machine is None:
        return 0.5
    places, values = features(text, n_chars)
    return float(1 / (1 + np.exp(-np.clip(machine.raw_score(places, machine.standard(values)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> Machine | None:
    """A machine fitted to (places, values, label) rows, in a fixed order of passes."""
    if not rows:
        return None
    stats = np.array([v[:STATS] for _, v, _ in rows], np.float64)
    random = np.random.default_rng(17)
    size = STATS + N_WORDS
    y = np.array([label for _, _, label in rows], np.float64)
    share = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(
        float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.05, (size, FACTORS)), stats.mean(axis=0), stats.std(axis=0) + 1e-3
    )
    xs = [m.standard(v) for _, v, _ in rows]
    g_bias, g_weights, g_factors = 1.0, np.ones(size), np.ones((size, FACTORS))
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            places, x = rows[i][0], xs[i]
            v = m.factors[places]
            total = x @ v
            raw = m.bias + m.weights[places] @ x + 0.5 * float((total**2).sum() - (x**2 @ v**2).sum())
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
            if abs(slope) < 1e-3:
                continue
            dw = slope * x + decay * m.weights[places]
            dv = slope * (x[:, None] * total - v * (x**2)[:, None]) + decay * v
            g_bias += slope**2
            m.bias -= rate * slope / np.sqrt(g_bias)
            g_weights[places] += dw**2
            m.weights[places] -= rate * dw / np.sqrt(g_weights[places])
            g_factors[places] += dv**2
            m.factors[places] -= rate * dv / np.sqrt(g_factors[places])
    return m


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine | None:
    """Fit on the labelled rows of `docs` that are not held out; the driver gets at most about `sample_docs` sparse rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality sample")), F.lit(1_000_000))
    known = known.where(place < min(1_000_000, 1_000_000 * sample_docs // max(1, n)))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, c) for t, c in zip(batch["text"], batch["n_chars"])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "places": [p.astype(np.int32).tobytes() for p, _ in found],
                "weights": [v.tobytes() for _, v in found], "quality": batch["quality"],
            })

    # At most about `sample_docs` rows of two numbers: small by construction, so they are broadcast.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("double").alias("n_chars"))
    chosen = chosen.join(F.broadcast(known), "doc_id").groupBy("doc_id", F.col("__quality").cast("int").alias("quality"))
    # One row for each doc_id, however often it is repeated.
    chosen = chosen.agg(F.min(F.struct("text", "n_chars")).alias("least")).select("doc_id", "least.text", "least.n_chars", "quality")
    found = chosen.mapInPandas(extract, "doc_id bigint, places binary, weights binary, quality int").toPandas().sort_values(["doc_id", "quality"])
    return fit([
        (np.frombuffer(p, np.int32).astype(np.int64), np.frombuffer(w, np.float32), int(q))
        for p, w, q in zip(found["places"], found["weights"], found["quality"])
    ])


def with_scores(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Every row of `docs` (text, n_chars) with `quality_score`, which replaces a column of that name."""
    return docs.withColumn("quality_score", _score(docs.sparkSession, machine, "text", "n_chars"))


def _score(spark: SparkSession, machine: Machine | None, text: str, n_chars: str) -> Column:
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scored(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([score_text(shared.value, t, c) for t, c in zip(texts, sizes)], dtype="float64")

    return scored(text, F.col(n_chars).cast("double"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, columns as they are."""
    machine = learn(docs, labels)
    # The caller's columns travel in one struct, so their names can't clash with the score's.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("score", _score(docs.sparkSession, machine, "row.text", "row.n_chars"))
    return rows.where(F.col("score") >= threshold).select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True)).alias("held_out")
    found = with_scores(docs, machine)
    predicted = (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", held_out, F.col("quality_score").alias("score"), predicted)
