"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labelled documents, at most about `per_class` toxic and as many others, chosen by a hash of doc_id among those whose
crc32(doc_id as text) mod 5 is not 0 (a bounded, documented sample; everything else covers all rows). The index's
terms are the `n_terms` words whose presence depends most on the label among the examples: chi-square of at least `LEAST_CHI`, which no word of a
large vocabulary reaches by chance, `LEAST_LIFT` times as frequent in one kind as in the other (toxic texts that are longer on average have more of every word),
in at least `MIN_EXAMPLES` examples with different texts and `MIN_SHARE` of the rarer kind's number, so that a few near copies don't make terms. A term's weight is
(1 + log tf) * log(1 + N / df), with df and N counted over all documents; vectors have unit length. Examples with equal vectors
are one entry of the index, which holds the share of toxic ones among them, each counted for as many labelled documents as it stands for.

The index is inverted (term to entries), its entries ordered by their heaviest terms and cut into blocks, and holds each term's
largest weight in each block. A search adds up, for each block, an upper bound of the cosines in it, visits blocks in descending order of their
bounds, scores all entries of a block from its postings, and ends when no bound left reaches the k-th best cosine. So it is exact: the `k`
entries of greatest cosine, of equals the first in the index.

The vote is the mean of the neighbours' toxic shares, weighted by 1 / (distance + `SOFTEN`) less what that is at distance 1, together with the share
of all labels, which has the weight `PRIOR`, so that far neighbours say little. A logistic curve fitted to the votes that the examples
get without themselves makes it a probability. A text without any term of the index has no neighbours; its score is the toxic share
of the examples without any.

Defined edge results: null and empty texts have no terms and are scored as such; a label or doc_id that is null is not learnt from; of several labels of a
doc_id the least counts, of several rows the least text; without an example of each kind every score is the toxic share of the labels
(0 without labels); rows with a null doc_id are held out; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.runtime import stored

PER_CLASS = 1500
TERMS = 400
MIN_EXAMPLES, MIN_SHARE = 5, 0.01
#: The chi-square (one degree of freedom) of a chance of 6e-7.
LEAST_CHI, LEAST_LIFT = 25.0, 3.0
K = 12
BLOCK = 32
SOFTEN, PRIOR = 0.05, 0.5
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall((text or "").lower())


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Index:
    """Postings by term and block: item j holds postings[j]..postings[j + 1] of one term in one block, items[t]..items[t + 1] are a term's."""

    idf: np.ndarray
    items: np.ndarray
    item_block: np.ndarray
    item_most: np.ndarray
    postings: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    share: np.ndarray
    doc_id: np.ndarray
    n_blocks: int

    @staticmethod
    def of(vectors: list[tuple[np.ndarray, np.ndarray]], share: np.ndarray, doc_id: np.ndarray, idf: np.ndarray) -> Index:
        """From the entries' (terms, unit weights)."""
        heaviest = [tuple(t[np.lexsort((t, -w))][:4]) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (heaviest[i], vectors[i][0].tobytes(), vectors[i][1].tobytes()))
        sizes = [len(vectors[i][0]) for i in order]
        entry = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by_term = np.lexsort((entry, term))
        entry, term, weight = entry[by_term], term[by_term], weight[by_term]
        block = entry // BLOCK
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        items = np.searchsorted(term[starts], np.arange(len(idf) + 1))
        most = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
        postings = np.r_[starts, len(term)].astype(np.int64)
        return Index(idf, items, block[starts], most, postings, entry, weight, share[order], doc_id[order], -(-len(order) // BLOCK))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit weights of distinct terms."""
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w**2).sum())

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, cosines) of the `k` nearest entries that share a term, nearest first, but for the entry `without`."""
        starts, ends = self.items[terms], self.items[terms + 1]
        item = _ranges(starts, ends)
        of_item = np.repeat(weights, ends - starts)
        block = self.item_block[item]
        bound = np.bincount(block, of_item * self.item_most[item], self.n_blocks)
        left = np.flatnonzero(bound)
        left = left[np.lexsort((left, -bound[left]))]
        found, cosines, step = np.zeros(0, np.int64), np.zeros(0), 2
        while len(left):
            take, left = left[:step], left[step:]
            chosen = np.isin(block, take)
            j = item[chosen]
            sizes = self.postings[j + 1] - self.postings[j]
            at = _ranges(self.postings[j], self.postings[j + 1])
            here, which = np.unique(self.entry[at], return_inverse=True)
            cosine = np.bincount(which, np.repeat(of_item[chosen], sizes) * self.weight[at])
            keep = here != without
            found, cosines = np.r_[found, here[keep]], np.r_[cosines, cosine[keep]]
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            if len(found) == k:
                left = left[bound[left] >= cosines[-1] - 1e-12]
            step *= 2
        return found, cosines


@dataclass
class Model:
    """terms: number of each term; without an index every score is `alone`."""

    terms: dict[str, int]
    index: Index | None
    alone: float
    prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.terms
        counts = Counter([known[w] for w in words_of(text) if w in known])
        terms = np.array(sorted(counts), np.int64)
        return terms, np.array([counts[t] for t in terms], np.float64)

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """The probability that the text is toxic, and the evidence: the nearest examples' doc_ids and cosines."""
        terms, counts = self.query(text) if self.index is not None else (np.zeros(0, np.int64), None)
        if not len(terms):
            return self.alone, [], []
        found, cosines = self.index.search(terms, self.index.vector(terms, counts))
        if not len(found):
            return self.alone, [], []
        raw = vote(self.index.share[found], cosines, self.prior)
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))), self.index.doc_id[found].tolist(), cosines.tolist()


def vote(share: np.ndarray, cosines: np.ndarray, prior: float) -> float:
    """The mean toxic share of the neighbours, the nearer ones counting more, and of all labels."""
    weight = 1 / (np.clip(1 - cosines, 0, 1) + SOFTEN) - 1 / (1 + SOFTEN)
    return float(((share * weight).sum() + prior * PRIOR) / (weight.sum() + PRIOR))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve fitted by Newton's steps to targets that are drawn in a little from 0 and 1."""
    up, down = weight[y > 0.5].sum(), weight[y <= 0.5].sum()
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(g * x).sum() + 1e-3 * a, g.sum()])
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: list[str], df: np.ndarray, n_docs: int, stands_for: tuple[float, float]) -> Model:
    """The model over (doc_id, toxic, terms, counts) rows; `stands_for`: labelled documents for each example that is not, or is, toxic."""
    idf = np.log1p(n_docs / np.maximum(1, df))
    entries: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    weights = {y: stands_for[y] for y in (0, 1)}
    alone = np.zeros(2)
    for doc_id, toxic, own, counts in examples:
        if len(own):
            entries.setdefault((own.astype(np.int64).tobytes(), counts.astype(np.float64).tobytes()), []).append((doc_id, toxic))
        else:
            alone[toxic] += weights[toxic]
    total = np.array([sum(weights[y] for _, y, _, _ in examples if y == c) for c in (0, 1)])
    prior = total[1] / max(1e-9, total.sum())
    bare = float((alone[1] + prior) / (alone.sum() + 1))
    if not entries or not total.all():
        return Model({}, None, float(prior))
    keys = list(entries)
    raw = [(np.frombuffer(t, np.int64), np.frombuffer(c, np.float64)) for t, c in keys]
    vectors = []
    for t, c in raw:
        w = (1 + np.log(c)) * idf[t]
        vectors.append((t, w / np.sqrt((w**2).sum())))
    mass = np.array([[sum(weights[y] for _, y in entries[k] if y == c) for c in (0, 1)] for k in keys])
    index = Index.of(vectors, mass[:, 1] / mass.sum(axis=1), np.array([min(d for d, _ in entries[k]) for k in keys]), idf)
    x, y, w = [], [], []
    order = sorted(range(len(keys)), key=lambda i: min(d for d, _ in entries[keys[i]]))
    place = {int(d): i for i, d in enumerate(index.doc_id)}
    for i in order:
        own = place[min(d for d, _ in entries[keys[i]])]
        found, cosines = index.search(*vectors[i], without=own)
        # Of the other examples with the same vector as many remain in the vote as there are besides each one.
        for c in (0, 1):
            if mass[i, c]:
                rest = mass[i] - np.eye(2)[c] * weights[c]
                if rest.sum() > 1e-9:
                    share, near = np.r_[rest[1] / rest.sum(), index.share[found][: K - 1]], np.r_[1.0, cosines[: K - 1]]
                else:
                    share, near = index.share[found], cosines
                if len(share):
                    x.append(vote(share, near, prior))
                    y.append(c)
                    w.append(mass[i, c])
    numbers = {t: k for k, t in enumerate(terms)}
    if not x:
        return Model(numbers, index, bare, float(prior))
    return Model(numbers, index, bare, float(prior), *logistic(np.array(x), np.array(y), np.array(w)))


def _counted(terms: dict[str, int] | None):
    """Rows (doc_id, text, toxic) become (doc_id, toxic, terms, counts): all words, or those of `terms` as their numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(words_of(t)) for t in batch["text"]]
            if terms is not None:
                found = [{terms[w]: c for w, c in sorted(f.items()) if w in terms} for f in found]
            columns = {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [list(f) for f in found], "counts": [list(f.values()) for f in found]}
            yield pd.DataFrame(columns)

    return count


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_terms: int = TERMS) -> Model:
    """The model of the labelled rows of `docs` that are not held out.

    The driver gets `n_terms` words with their counts and, of at most about 2 * `per_class` examples, the counts of those words.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = stored(known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("__toxic")), "toxic-labels")
    n = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, per_class / max(1, n.get(c, 0))) for c in (0, 1)}
    if not n.get(0) or not n.get(1):
        return Model({}, None, float(bool(n.get(1))))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic sample")), F.lit(1_000_000))
    cut = F.when(F.col("__toxic") == 1, int(1_000_000 * rate[1])).otherwise(int(1_000_000 * rate[0]))
    # At most about 2 * per_class rows of two numbers.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = chosen.join(F.broadcast(known.where(place < cut)), "doc_id").groupBy("doc_id", F.col("__toxic").alias("toxic"))
    chosen = stored(chosen.agg(F.min("text").alias("text")), "toxic-examples")
    words = chosen.mapInPandas(_counted(None), "doc_id bigint, toxic int, terms array<string>, counts array<int>")
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    once = words.groupBy("toxic", F.xxhash64("terms", "counts").alias("h")).agg(F.first("terms").alias("terms"))
    with_term = once.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    up, down = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    a, rest = F.col("a"), F.col("n") - F.col("a")
    cross = a * (down - rest) - rest * (up - a)
    chi = (up + down) * cross * cross / ((a + rest) * (up + down - a - rest) + F.lit(1e-9))
    lift = (a + 0.5) / (up + 1) / ((rest + 0.5) / (down + 1))
    least = max(MIN_EXAMPLES, MIN_SHARE * min(up, down))
    best = with_term.where(F.col("n") >= least).withColumn("chi", chi).where((F.col("chi") >= LEAST_CHI) & (F.greatest(lift, 1 / lift) >= LEAST_LIFT)).orderBy(F.desc("chi"), "term").limit(n_terms)
    terms = [r["term"] for r in best.select("term").collect()]
    numbers = {t: k for k, t in enumerate(terms)}

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(numbers) + 1, np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts[[numbers[w] for w in numbers.keys() & set(words_of(text))]] += 1
            counts[-1] += len(batch)
        yield pd.DataFrame({"k": np.arange(len(counts)), "n": counts})

    df = docs.select("text").mapInPandas(seen, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = np.array([r["n"] for r in sorted(df)], np.float64) if df else np.zeros(len(terms) + 1)
    rows = chosen.mapInPandas(_counted(numbers), "doc_id bigint, toxic int, terms array<int>, counts array<int>").orderBy("doc_id").collect()
    examples = []
    for r in rows:
        own, counts = np.array(r["terms"], np.int64), np.array(r["counts"], np.float64)
        order = np.argsort(own)
        examples.append((r["doc_id"], r["toxic"], own[order], counts[order]))
    stands_for = tuple(n[c] / max(1, sizes.get(c, 0)) for c in (0, 1))
    return fit(examples, terms, df[:-1], int(df[-1]), stands_for)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of `docs` (text) with `toxicity`: a struct (score, examples, cosines), the nearest example first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, examples: array<bigint>, cosines: array<double>>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        rows = [shared.value.score(t) for t in texts]
        return pd.DataFrame({"score": [r[0] for r in rows], "examples": [r[1] for r in rows], "cosines": [r[2] for r in rows]})

    return docs.withColumn("toxicity", scored("text"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the toxicity score of every document, with the nearest labelled examples as evidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")
    found = with_scores(docs, model).select("doc_id", held_out, F.col("toxicity.score").alias("score"), F.col("toxicity.examples").alias("examples"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "examples")
