"""Toxicity by nearest examples against brute-force cosines, held-out accuracy, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import toxicity as t

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
RUDE = "nasty vile rotten foul".split()
SCHEMA = "doc_id long, text string, lang string, toxicity string, score double, terms int"


def a_text(pick, rude, n=40):
    words = [pick.choice(WORDS) for _ in range(n)] + [pick.choice(RUDE) for _ in range(3 if rude else 0)]
    pick.shuffle(words)
    return " ".join(words).capitalize() + "."


def corpus(n=600, seed=2):
    pick = random.Random(seed)
    rude = [pick.random() < 0.2 for _ in range(n)]
    return [(k, a_text(pick, rude[k]), "en", "x", 1.0, 2) for k in range(n)], [(k, int(rude[k])) for k in range(0, n, 2)]


def test_search_is_exact():
    random_ = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        terms = np.unique(random_.integers(0, 80, random_.integers(1, 9)))
        w = random_.random(len(terms)) + 0.1
        vectors.append((terms, w / np.sqrt((w**2).sum())))
    vectors += [(np.array([5]), np.array([1.0]))] * 40  # ties
    index = t.Index.of(vectors, np.zeros(len(vectors)), np.arange(len(vectors)), np.ones(80))
    dense = np.zeros((len(vectors), 80))
    for entry, v in enumerate(index.doc_id):
        dense[entry, vectors[v][0]] = vectors[v][1]
    for _ in range(300):
        terms = np.unique(random_.integers(0, 80, 5))
        w = random_.random(len(terms))
        w /= np.sqrt((w**2).sum())
        cosines = dense[:, terms] @ w
        want = np.lexsort((np.arange(len(cosines)), -np.round(cosines, 12)))[: t.K]
        found, got = index.search(terms, w)
        assert np.allclose(got, cosines[found]) and np.allclose(np.sort(got), np.sort(cosines[want][cosines[want] > 0]))
    found, got = index.search(np.array([5]), np.array([1.0]))
    assert np.allclose(got, 1) and list(found) == sorted(np.flatnonzero(dense[:, 5] > 1 - 1e-12))[: t.K]


def test_neighbours_equal_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts, toxic = {r[0]: r[1] for r in rows}, dict(labels)
    learnt = [d for d in toxic if zlib.crc32(str(d).encode()) % 5]

    def words(d):
        return Counter(w for w in re.findall("[a-z]+", texts[d].lower()) if w in model.terms)

    df = Counter(w for d in texts for w in words(d))

    def vector(d):
        raw = {w: (1 + math.log(c)) * math.log(1 + len(texts) / df[w]) for w, c in words(d).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    known = {d: vector(d) for d in learnt if words(d)}
    for r in t.with_scores(docs, model).where("doc_id % 7 = 0").collect():
        own = vector(r["doc_id"])
        entries = {}
        for d, v in known.items():
            key = tuple(sorted(words(d).items()))
            entries[key] = sum(x * v.get(w, 0) for w, x in own.items())
        best = sorted((x for x in entries.values() if x > 0), reverse=True)[: t.K]
        assert np.allclose(r["toxicity"]["cosines"], best)
        assert set(r["toxicity"]["examples"]) <= set(learnt)


def test_held_out_accuracy(spark):
    rows, labels = corpus(900, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r["doc_id"]: r["toxicity"]["score"] for r in t.with_scores(docs, model).collect()}
    held = [(score[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 60 and all((s >= t.THRESHOLD) == bool(y) for s, y in held)


def test_given_tables(spark, sf_dir):
    rows = t.op11_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


EDGES = [(1, None), (2, ""), (2, "foul " * 30), (2, "foul " * 30), (None, "vile"), (3, "alpha " * 50_000 + "vile"), (4, " \t\n"), (5, "日本語 ÀÉ")]


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)], [(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (9, 1)]])
@pytest.mark.parametrize("rows", [EDGES, []])
def test_edge_cases(spark, rows, labels):
    docs = spark.createDataFrame([(d, x, "en", "x", 1.0, 2) for d, x in rows], SCHEMA)
    model = t.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = t.with_scores(docs, model)
    assert found.columns == docs.columns
    scores = [r["toxicity"]["score"] for r in found.collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    if labels and all(y == 1 for _, y in labels):
        assert all(s == 1 for s in scores)
