"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of up to three bytes is counted on a sample of labelled texts
(lower-cased, UTF-8). The code length of a byte is that of the longest counted context: with n the count of
the byte after it, N of all bytes after it and D of distinct ones, a seen byte costs -log2(n / (N + D)); an
unseen one costs the escape -log2(D / (N + D)) and is coded in the context shortened by one; below the
empty context all 256 bytes are equally likely. Statistics are frozen after counting, so a text's code
length in a language is an exact sum over all of its bytes, whatever else is scored.

Counts of languages don't mix, so the trees of up to `BLOCK` languages are laid out together: sorted context-and-byte
sequences that any of them counted, with their code lengths in each language, and sorted contexts with their
escapes, for each length of context. A byte is looked up with its whole context first and, only where no language
has counted that, with a shorter one and the escape added. Nothing counted is left out. The layout is broadcast; its size is
bounded by the sample, that is, by the number of languages: about a megabyte for each.

The sample: rows with a language whose crc32(doc_id as text) mod 3 is not 1, at most about
`sample_docs` of each language, chosen by a hash of doc_id; texts are counted whole, on the executors.

Defined edge results: a null text or one without a letter (a character of the Unicode categories of letters) is `und` with score 0; so is any text if there
is nothing to learn from; ties go to the language that comes first by name; rows with a null doc_id are
held out; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = 3
SAMPLE_DOCS = 600
#: Languages laid out side by side.
BLOCK = 8
PAD = b"\n" * ORDER
CHUNK = 1 << 20


@dataclass
class Model:
    """Trees of some languages, for contexts of 0, 1, 2 and 3 bytes.

    grams[k]: sorted sequences of k + 1 bytes as numbers; bits[k]: (sequence, language) code lengths; contexts[k]: sorted
    sequences of k bytes; escapes[k]: (context, language).
    """

    languages: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of four-byte sequences (three of context and the byte), packed into a long."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts = [np.frombuffer(PAD + _bytes(t), np.uint8).astype(np.int64) for t in texts]
                grams = [(b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:] for b in parts]
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    counted = sample.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample_of(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows to learn from: a share of each language's labelled rows that holds about `sample_docs` of them."""
    named = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    named = named.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1_000_000))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen |= (F.col("lang") == lang) & (place < min(1_000_000, 1_000_000 * sample_docs // n))
    return named.where(chosen)


def build(grams: pd.DataFrame) -> list[Model]:
    """The models of counted grams (lang, gram, n), one for each `BLOCK` languages in order of their names; none without grams."""
    languages = sorted(grams["lang"].unique())
    blocks = [languages[k : k + BLOCK] for k in range(0, len(languages), BLOCK)]
    return [_block(block, grams[grams["lang"].isin(block)]) for block in blocks]


def _block(languages: list[str], counted: pd.DataFrame) -> Model:
    n_lang = len(languages)
    whole, n = counted["gram"].to_numpy(), counted["n"].to_numpy().astype(np.float64)
    lang = np.searchsorted(languages, counted["lang"].to_numpy(dtype=object))
    model = Model(languages, [], [], [], [])

    def added(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at * n_lang + lang, weights=n, minlength=len(found) * n_lang).reshape(-1, n_lang)

    for k in range(ORDER + 1):
        gram, times = added(whole & ((1 << 8 * (k + 1)) - 1))
        context, total = added((whole & ((1 << 8 * (k + 1)) - 1)) >> 8)
        of = np.searchsorted(context, gram >> 8)
        distinct = np.stack([np.bincount(of, weights=times[:, j] > 0, minlength=len(context)) for j in range(n_lang)], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            seen = -np.log2(times / (total + distinct)[of])
        if k:
            shorter = model.bits[k - 1][np.searchsorted(model.grams[k - 1], gram & ((1 << 8 * k) - 1))]
        else:
            shorter = 8.0
        model.grams.append(gram)
        model.bits.append(np.where(times > 0, seen, escape[of] + shorter).astype(np.float32))
        model.contexts.append(context)
        model.escapes.append(escape.astype(np.float32))
    return model


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `keys` among sorted ones, and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _lengths(model: Model, gram: np.ndarray) -> np.ndarray:
    """Code length of the last bytes of sequences of four, for each language."""
    total = np.zeros(len(model.languages))
    for k in range(ORDER, -1, -1):
        at, there = _found(model.grams[k], gram)
        total += model.bits[k][at[there]].sum(axis=0, dtype=np.float64)
        gram = gram[~there]
        if not len(gram):
            break
        at, there = _found(model.contexts[k], gram >> 8)
        total += model.escapes[k][at[there]].sum(axis=0, dtype=np.float64)
        gram = gram & ((1 << 8 * k) - 1)
    else:
        total += 8.0 * len(gram)
    return total


def code_lengths(models: list[Model], texts: list[str | None]) -> np.ndarray:
    """(text, language): exact code length in bits of each text; languages in order of the models."""
    out = np.zeros((len(texts), sum(len(m.languages) for m in models)))
    for k, text in enumerate(texts):
        raw = np.frombuffer(PAD + _bytes(text), np.uint8)
        for at in range(0, len(raw) - ORDER, CHUNK):
            b = raw[at : at + CHUNK + ORDER].astype(np.int64)
            gram = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
            out[k] += np.concatenate([_lengths(m, gram) for m in models])
    return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[Model]:
    """The frozen models of `docs` (doc_id, text, lang)."""
    return build(count_grams(sample_of(docs, sample_docs)).toPandas())


def identify(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """Every row of `docs` with `lang_pred` and `score`, the probability of that language if all are as likely beforehand."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batch: pd.Series) -> pd.DataFrame:
        known = shared.value
        texts = batch.tolist()
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if known and has_letter(t)]
        if some:
            lengths = code_lengths(known, [texts[i] for i in some])
            best = lengths.argmin(axis=1)
            rest = lengths - lengths.min(axis=1, keepdims=True)
            names[some] = np.array([lang for m in known for lang in m.languages], object)[best]
            scores[some] = 1 / np.exp2(-np.minimum(rest, 1000.0)).sum(axis=1)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    marked = F.pandas_udf(predict, "lang_pred string, score double")
    rows = docs.select(F.struct(*docs.columns).alias("row"), marked(text).alias("found"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return rows.select(*own, "found.lang_pred", "found.score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = learn(docs)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True)).alias("held_out")
    return identify(docs.select("doc_id", "text"), models).select("doc_id", held_out, "lang_pred", "score")
