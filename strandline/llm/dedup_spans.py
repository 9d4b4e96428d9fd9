"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences at line feeds and after `.`, `!` or `?` before white space. A sentence of
more than `LONG_SENTENCE` words is cut further after the word of least hash, the last of equals, in each
window of `CUT_WINDOW` words, so that a passage within a text without stops is cut alike wherever it stands
(but for `CUT_WINDOW` - 1 words at either end) and no piece of it is longer than a window, whatever its words
and however often they repeat. Any passage of 51 words therefore holds a whole span: at most 15 words go
by to the first cut that doesn't depend on the text around it, the span ends within 27 more, and cuts up
to the 44th word are fixed; where a sentence cut off by the passage's end has up to `LONG_SENTENCE`
words, so that the text around it decides whether it is cut, its stop takes the place of the cut.

Removed are the sentences that any run of two or more sentences with at least `min_words` words covers, where
the same run stands earlier (by document, then text hash, then position). Runs of every length count, yet only the
least ones are hashed: the shortest run from each sentence on and the shortest one up to each sentence. Of a repeated
run the shortest from its first sentence on and the shortest up to its last lie within it and are repeated with it, and
so does for each sentence between them one of the two kinds; together they cover the whole run. A span's hash is that
of its words, lower-cased (white space plays no part). All spans are joined by hash over the whole table.

A span travels as its document and its number within it, and the cleaning task finds its place again from the text, so
the rows of both shuffles are narrow. The text's hash is part of a document's key only where an id has several texts.

Hashes have 96 bits, so no span is removed for a chance collision. Occurrences are matched with the first of their hash only, an aggregate
that combines on the map side; the join is between written tables, so a span that a third of all documents
share is split by adaptive execution. No group is collected.

Defined edge results: null texts stay null; empty texts and texts with a single sentence have no span;
rows that repeat a doc_id with the same text count as one document (equal rows get equal results), with another text
as separate documents in order of the text's hash; a null doc_id comes first in order; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored

WORD = re.compile(r"\S+")
MIN_WORDS = 20
MIN_SENTENCES = 2
LONG_SENTENCE = 12
CUT_WINDOW = 8
CACHE_WORDS = 400_000
#: Texts whose spans are held at a time.
SLICE_ROWS = 1_000

#: For each word its hash, or HARD - hash - 1 (below zero) if it ends a sentence.
HARD = 0
_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    if len(_HASHES) >= CACHE_WORDS:
        _HASHES.clear()
    number = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    found = _HASHES[word] = HARD - number - 1 if word[-1] in ".!?" else number
    return found


def window_cuts(hashes: list[int]) -> list[int]:
    """Places (numbers of words) after the least hash, the last of equals, of each window of `CUT_WINDOW` hashes."""
    found, best, cut = [], 0, -1
    for k, h in enumerate(hashes):
        if h <= hashes[best]:
            best = k
        elif best <= k - CUT_WINDOW:
            best = k - CUT_WINDOW + 1
            for m in range(best + 1, k + 1):
                if hashes[m] <= hashes[best]:
                    best = m
        if best != cut and k >= CUT_WINDOW - 1:
            found.append(best + 1)
            cut = best
    return found


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The lower-cased words of a text, and the end of each sentence as a number of words."""
    words: list[str] = []
    ends: list[int] = []
    hashes = _HASHES
    for line in text.lower().split("\n"):
        here = line.split()
        if not here:
            continue
        base = len(words)
        words += here
        found = [hashes[w] if w in hashes else _hash(w) for w in here]
        begin, n = 0, len(found)
        for k in [k for k, h in enumerate(found, 1) if h < HARD or k == n]:
            if k - begin > LONG_SENTENCE:
                # The last word takes part by its hash, without the mark.
                own = found[begin:k]
                own[-1] = own[-1] if own[-1] >= HARD else HARD - own[-1] - 1
                ends += [base + begin + x for x in window_cuts(own) if x < k - begin]
            ends.append(base + k)
            begin = k
    return words, ends


def spans(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(first sentence, last sentence, start, end, hash) of each span, in order; start and end count words, the hash has 16 bytes."""
    words, ends = sentences(text)
    found, begin, last, n = [], 0, 0, len(ends)
    for i, own_end in enumerate(ends):
        last = max(last, i + MIN_SENTENCES - 1)
        while last < n and ends[last] - begin < min_words:
            last += 1
        if last >= n:
            break
        # The shortest run from here on, then those up to later sentences that the next sentence is too late for.
        j = last
        while j == last or j < n and ends[j] - own_end < min_words:
            joined = " ".join(words[begin : ends[j]]).encode("utf-8", "surrogatepass")
            found.append((i, j, begin, ends[j], xxhash.xxh3_128_digest(joined)))
            j += 1
        begin = own_end
    return found


SPAN_SCHEMA = "key struct<id: bigint, text_hash: bigint>, number int, again boolean, h1 bigint, h2 int"
#: Stands for a null document id, which comes first in order.
NO_ID = -(1 << 63)


def _spans(min_words: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[k : k + SLICE_ROWS] for b in batches for k in range(0, len(b), SLICE_ROWS)):
            counts, digests, again = [], [], []
            for text in batch["text"]:
                found = [digest for *_, digest in spans(text, min_words)]
                seen: set[bytes] = set()
                for digest in found:
                    again.append(digest in seen)
                    seen.add(digest)
                digests += found
                counts.append(len(found))
            if not digests:
                continue
            hashes = np.frombuffer(b"".join(digests), np.dtype([("h1", "<i8"), ("h2", "<i4"), ("rest", "<i4")]))
            out = pd.DataFrame({"number": np.concatenate([np.arange(n, dtype=np.int32) for n in counts])})
            out.insert(0, "key", batch["key"].repeat(counts).to_numpy())
            yield out.assign(again=np.array(again), h1=hashes["h1"], h2=hashes["h2"])

    return cut


def _own_id(doc_key: Column) -> Column:
    return F.coalesce(doc_key.cast("long"), F.lit(NO_ID))


def ids_of_several_texts(docs: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id): ids that stand at different texts, null and empty ones included; as a rule none."""
    keys = docs.select(_own_id(F.col(doc_key)).alias("id"), F.xxhash64(text).alias("text_hash"))
    ids = keys.groupBy("id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    return stored(ids.where("least < most").select("id"), "ids-of-several-texts")


def repeated_spans(docs: DataFrame, ids: DataFrame | None = None, doc_key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, number, first_id): a row for each later occurrence (two if documents of its own id hold it, too).

    `number` counts the text's `spans`; `first_id` is the document of the first occurrence. `ids` are those of several
    texts; without them `key.text_hash` is 0.
    """
    text_hash = F.lit(0).cast("long") if ids is None else F.xxhash64(text)
    key = F.struct(_own_id(F.col(doc_key)).alias("id"), text_hash.alias("text_hash"))
    rows = docs.where(F.length(text) > 0).select(key.alias("key"), F.col(text).alias("text"))
    found = rows.mapInPandas(_spans(min_words), SPAN_SCHEMA)
    # One long holds the number and `again`, as narrow rows are what the shuffle writes.
    place = F.shiftleft(F.col("number").cast("long"), 1).bitwiseOR(F.col("again").cast("long")).alias("place")
    found = found.select("key.id", *(["key.text_hash"] if ids is not None else []), place, "h1", "h2")
    found = stored(found, "spans")
    firsts = found.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").drop("n"), "first-spans")
    again = F.col("place").bitwiseAND(F.lit(1)) == 1
    columns = [*(c for c in found.columns if c not in ("h1", "h2")), "first_id"]
    later = found.join(firsts, ["h1", "h2"]).where(again | (F.col("id") > F.col("first_id"))).select(columns)
    if ids is not None:
        # Of different texts of one id the one of the least hash comes first.
        twins = stored(found.join(ids, "id"), "spans-of-several-texts")
        least = twins.groupBy("id", "h1", "h2").agg(F.min("text_hash").alias("least"), F.count("*").alias("n")).where("n > 1")
        more = twins.join(least, ["id", "h1", "h2"]).where("text_hash > least")
        later = later.union(more.withColumn("first_id", F.col("id")).select(columns))
    own_hash = F.lit(0).cast("long") if ids is None else F.col("text_hash")
    return later.select(
        F.struct("id", own_hash.alias("text_hash")).alias("key"), F.shiftright("place", 1).cast("int").alias("number"), "first_id"
    )


def _runs_of_numbers(later: DataFrame) -> DataFrame:
    """(key, runs): later spans with consecutive numbers as one (from, to, first_ids). Windows run over one document's spans."""
    by_doc = Window.partitionBy("key").orderBy("number")
    marked = later.withColumn("new", F.coalesce((F.col("number") > F.lag("number").over(by_doc) + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("key", "run").agg(
        F.min("number").alias("from"), F.max("number").alias("to"), F.collect_set("first_id").alias("first_ids")
    )
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "to", "first_ids"))).alias("runs"))


REMOVED = "array<struct<start:int,end:int,first_sentence:int,last_sentence:int,first_ids:array<bigint>>>"


def covered_runs(text: str, runs: list[tuple[int, int, list[int]]], min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, list[int]]]:
    """What spans of these numbers (from, to, first ids) cover: (start, end, first sentence, last sentence, first ids), overlapping and adjacent ones as one."""
    found, out = spans(text, min_words), []
    for low, high, first_ids in sorted(runs, key=lambda r: r[0]):
        for i, j, start, end, _ in found[low : high + 1]:
            if out and i <= out[-1][3] + 1:
                run = out[-1]
                run[1], run[3] = max(run[1], end), max(run[3], j)
                run[4].update(first_ids)
            else:
                out.append([start, end, i, j, set(first_ids)])
    return [(start, end, i, j, sorted(ids)) for start, end, i, j, ids in out]


def without_words(text: str, runs: list[tuple[int, int]]) -> str:
    """`text` without the words start..end-1 of each run and the white space that follows them."""
    words = [m.span() for m in WORD.finditer(text)] + [(len(text), len(text))]
    parts, at = [], 0
    for start, end in sorted(runs):
        parts.append(text[at : words[start][0]])
        at = words[end][0]
    return "".join([*parts, text[at:]])


#: Bytes of runs up to which they are broadcast to the documents.
BROADCAST_BYTES = 32 << 20


def dedup_spans(
    docs: DataFrame, doc_key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every row of `docs`, its text without the sentences of later spans; adds `n_removed_words` and `removed`.

    `removed` holds the runs that went: (start, end, first_sentence, last_sentence, first_ids), empty in an untouched document.
    """
    ids = ids_of_several_texts(docs, doc_key, text)
    ids = None if ids.isEmpty() else ids
    runs = stored(_runs_of_numbers(repeated_spans(docs, ids, doc_key, text, min_words)), "runs")
    size = F.aggregate("runs", F.lit(100), lambda s, r: s + 60 + 8 * F.size(r["first_ids"]))
    small = (runs.agg(F.sum(size.cast("long"))).first()[0] or 0) <= broadcast_bytes
    runs = F.broadcast(runs) if small else runs.hint("merge")
    # The caller's columns travel in one struct, so their names can't clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text_hash = F.lit(0).cast("long") if ids is None else F.xxhash64(F.col("row")[text])
    same = (_own_id(F.col("row")[doc_key]) == F.col("key.id")) & (text_hash == F.col("key.text_hash"))
    out = rows.join(runs, same, "left")

    @F.pandas_udf(f"text string, removed {REMOVED}")
    def clean(texts: pd.Series, lows: pd.Series, highs: pd.Series, first_ids: pd.Series) -> pd.DataFrame:
        cleaned, removed = [], []
        for t, low, high, firsts in zip(texts, lows, highs, first_ids):
            gone = [] if t is None else covered_runs(t, list(zip(low, high, firsts)), min_words)
            cleaned.append(without_words(t, [r[:2] for r in gone]) if gone else t)
            removed.append([dict(zip(("start", "end", "first_sentence", "last_sentence", "first_ids"), r)) for r in gone])
        return pd.DataFrame({"text": pd.Series(cleaned, dtype=object), "removed": pd.Series(removed, dtype=object)})

    # Untouched texts don't go to Python.
    touched = F.when(F.col("runs").isNotNull(), F.col("row")[text])
    out = out.withColumn("cleaned", clean(touched, F.col("runs.from"), F.col("runs.to"), F.col("runs.first_ids")))
    removed = F.col("cleaned.removed")
    added = {
        text: F.when(F.size(removed) > 0, F.col("cleaned.text")).otherwise(F.col("row")[text]),
        "n_removed_words": F.aggregate(removed, F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]),
        "removed": removed,
    }
    own = [added.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return out.select(*own, *[column.alias(name) for name, column in added.items() if name not in docs.columns])


def op2_dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document, its text without later spans, and the runs that went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_spans(docs)
