"""Benchmark decontamination with DataFrame functions only.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is lower-cased. A benchmark window is
`width` consecutive words of an item; an item of fewer words, but not none, is one window. Windows are
hashed on both sides in the same way, the benchmark's distinct hashes (a dozen bytes each) are broadcast when their number
is within `broadcast_rows` (counted first; beyond it the join is shuffled), all document windows, of all
widths at once, are scanned against them, and each hit is verified word by word before it counts. Words of windows and item
ids meet the hits only, not the documents.

Hashes of long windows are built by doubling: the hash of 2w words combines two hashes of w words, so a
document of n words costs a few passes over arrays of n longs, and no window text is ever built.

Defined edge results: null or empty texts and texts without words have no windows and no hits; null
benchmark texts are ignored, null item ids name no item but their windows count; rows that repeat a doc_id are each checked
on their own text (hits are kept by doc_id and a hash of the text, so rows without an id don't meet, either); null doc_ids
are kept; other columns pass through untouched, also when their names clash with internal ones (internal
columns and the caller's never share a row's top level); a column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.runtime import stored

WIDTH = 10
#: What separates words, as a Java regular expression.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct window hashes up to which they are broadcast; each is a long and an int, about 50 bytes in the table of a join.
BROADCAST_ROWS = 1_000_000
#: Bytes of hits (their words and item ids counted) up to which they are broadcast to the documents.
BROADCAST_BYTES = 96 << 20


def words(text: Column) -> Column:
    """The array of words of a text; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _joined(left: Column, right: Column, by: int) -> Column:
    """Hash of the window that starts at i: left[i] combined with right[i + by]; shorter by `by`."""
    n = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), _shift(right, by), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(df: DataFrame, words_col: str, widths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Add arrays of window hashes, one for each width; returns their column names.

    `__h<w>` at i is the hash of words i..i+w-1. Powers of two are built by doubling, other widths from
    the highest bit down.
    """
    df = df.withColumn("__h1", F.transform(words_col, lambda w: F.xxhash64(w)))
    power, most = 1, max(widths)
    while power * 2 <= most:
        df = df.withColumn(f"__h{power * 2}", _joined(F.col(f"__h{power}"), F.col(f"__h{power}"), power))
        power *= 2
    names = {}
    for width in widths:
        bits = [1 << k for k in range(width.bit_length() - 1, -1, -1) if width >> k & 1]
        name, done = f"__h{bits[0]}", bits[0]
        for bit in bits[1:]:
            target = f"__h{done + bit}"
            if target not in df.columns:
                df = df.withColumn(target, _joined(F.col(name), F.col(f"__h{bit}"), done))
            name, done = target, done + bit
        names[width] = name
    return df, names


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: (width, hash, window_words, item_ids); equal windows of several items are one row."""
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    cut = items.select("item", F.least(n, F.lit(width)).alias("width"), "w", F.explode(starts).alias("at"))
    cut = cut.select("item", "width", F.slice("w", F.col("at") + 1, F.col("width")).alias("window_words"))
    return cut.groupBy("width", "window_words").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))


def hashed_windows(windows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Stored windows with a `hash` column, and their distinct widths (at most `width` of them)."""
    windows = stored(windows, "windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())
    hashed = windows.withColumn("hash", F.lit(None).cast("long")).limit(0)
    for width in widths:
        side, names = with_window_hashes(windows.where(F.col("width") == width), "window_words", [width])
        hashed = hashed.union(side.select(*windows.columns, F.col(names[width])[0].alias("hash")))
    return stored(hashed, "hashed-windows"), widths


def _key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that repeat a doc key or have none."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("text_hash"))


def find_windows(
    docs: DataFrame,
    windows: DataFrame,
    doc_key: str,
    text_col: str,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame | None:
    """Candidate hits by hash: one row per key with `hits`, an array of (at, width, window, item_ids).

    None if the benchmark has no window at all.
    """
    windows, widths = hashed_windows(windows)
    if not widths:
        return None
    hashes = windows.select("hash", "width").distinct()
    small = hashes.count() <= broadcast_rows
    scan = docs.select(_key(F.col(doc_key), F.col(text_col)).alias("key"), words(F.col(text_col)).alias("__w"))
    scan, names = with_window_hashes(scan, "__w", widths)
    # The windows of all widths in one array; a window's width tells where its part of the array begins.
    n = F.size("__w")
    every = F.flatten(F.array(*[F.col(names[w]) for w in widths])) if len(widths) > 1 else F.col(names[widths[0]])
    # The outer form: the inner one adds a filter on the array's size that repeats the whole expression.
    rows = scan.select("key", n.alias("n"), F.posexplode_outer(every).alias("place", "hash"))
    found = rows.join(F.broadcast(hashes) if small else hashes, "hash")

    def windows_of(width: int) -> Column:
        return F.greatest(F.col("n") - (width - 1), F.lit(0))

    at, before = F.lit(-1), F.lit(0)
    for width in widths:
        own = F.col("place") - before
        at = F.when((F.col("width") == width) & (own >= 0) & (own < windows_of(width)), own).otherwise(at)
        before = before + windows_of(width)
    found = stored(found.select("key", "hash", "width", at.alias("at")).where("at >= 0").distinct(), "found")
    # Words hold no blanks, so a window's words are one text.
    found = found.join(windows.withColumn("window", F.array_join("window_words", " ")), ["hash", "width"])
    hits = F.collect_set(F.struct("at", "width", "window", "item_ids"))
    return found.groupBy("key").agg(hits.alias("hits"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    doc_key: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every row of `docs` with its verified hits.

    Added columns: `n_words` and `n_hit` (long), `items` (sorted strings of the item ids found),
    `spans` (array of [start, end) word positions hit, merged), `contaminated`.
    """
    hits = find_windows(docs, benchmark_windows(benchmark, width), doc_key, text_col, broadcast_rows)
    # The caller's columns travel in one struct, so their names can't clash with those used here.
    out = docs.select(F.struct(*docs.columns).alias("row"))
    if hits is None:
        out = out.withColumn("hits", F.array().cast("array<struct<at:int,width:int,window:string,item_ids:array<bigint>>>"))
    else:
        hits = stored(hits, "hits")
        one = F.aggregate("hits", F.lit(0), lambda s, h: s + 80 + F.octet_length(h["window"]) + 8 * F.size(h["item_ids"]))
        small = (hits.agg(F.sum(100 + one.cast("long"))).first()[0] or 0) <= broadcast_bytes
        hits = F.broadcast(hits) if small else hits.hint("merge")
        same = F.col("row")[doc_key].eqNullSafe(F.col("key.id")) & (F.xxhash64(F.col("row")[text_col]) == F.col("key.text_hash"))
        out = out.join(hits, same, "left").drop("key")
    out = out.withColumn("w", words(F.col("row")[text_col]))  # after the join, which moves texts only where the hits are many
    verified = F.filter("hits", lambda h: F.array_join(F.slice(F.col("w"), h["at"] + 1, h["width"]), " ") == h["window"])
    out = out.withColumn("hits", F.when(F.col("hits").isNotNull(), verified))
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("start"), (h["at"] + h["width"]).alias("end"))))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (x["start"] > F.try_element_at(done, F.lit(-1))["end"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        )

    spans = F.when(F.coalesce(F.size("hits"), F.lit(0)) <= 0, empty).otherwise(F.aggregate(ordered, empty, merge))
    out = out.withColumn("spans", spans)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["item_ids"], lambda i: i.cast("string"))))))
    added = {
        "n_words": F.size("w").cast("long"),
        "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]),
        "items": F.coalesce(items, F.array().cast("array<string>")),
        "spans": F.col("spans"),
        "contaminated": F.size("spans") > 0,
    }
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return out.select(*own, *[column.alias(name) for name, column in added.items()])


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` without any verified benchmark window, with the columns of `docs`."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole"))
    return decontaminate(packed, benchmark, width).where(~F.col("contaminated")).select(*[F.col("whole")[c].alias(c) for c in docs.columns])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Query: hits of benchmark windows in every document (see the module docstring for edge cases)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS width, array_to_string(w[begins:begins + least(len(w), {WIDTH}) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) s(begins) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM windows
), places AS (
  SELECT doc_id, begins, width, array_to_string(w[begins:begins + width - 1], ' ') AS words
  FROM cut CROSS JOIN widths, unnest(range(1, greatest(len(w) - width + 2, 1))) s(begins)
), hits AS (
  SELECT DISTINCT doc_id, begins, width, item_id FROM places JOIN windows USING (width, words)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(begins, begins + width)) AS p FROM hits) GROUP BY 1
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM cut LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
