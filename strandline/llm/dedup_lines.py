"""Removal of repeated runs of lines, by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines (split at line feeds; trailing blanks cut; blank lines take no
part and are always kept). Line hashes are winnowed: in every window of `min_run` lines the least hash is
selected, so any run of `min_run` lines carries a selected line at the same offset wherever it occurs.
Selected lines are joined by hash. At each selected line that occurs more than once the match is
extended to both sides: every run of exactly `min_run` lines around it is hashed, and a run that was seen
earlier (in order of document, then position) is a later repeat. Overlapping runs make up repeats of any
greater length. Lines of later repeats are deleted, first occurrences stay. As every run of `min_run`
lines holds a selected line, the result is exact: a line goes if and only if it lies in a run of
`min_run` lines that occurred before.

With `min_words` a run of fewer lines counts, too, if it has that many words (its lines together), down to
a single line. Such a run has a line with its share of the words, so all lines with that share are selected
besides the winnowed ones, and runs of every length around a selected line are hashed. The result is exact
again: a line goes if and only if it lies in a run that occurred before and has `min_run` lines or
`min_words` words. The query op3 keeps to runs of `min_run` lines, as its SQL does; the pipeline sets both.

Lines are joined by 64 bits, but a run counts as seen only if 128 bits agree (two hashes of its lines, each made of line
hashes of its own seed), so no line is deleted for a chance collision even among 10^12 runs.

Occurrences are matched with the first one only (an aggregate with map-side combination), never with one
another, so a line shared by a third of all documents costs a row for each occurrence. Both sides of each
join are written tables, so adaptive execution can split a hot key.

Defined edge results: null texts stay null and count no lines; an empty text has no lines; without
`min_words`, documents with fewer than `min_run` lines that take part are left as they are; rows that repeat a doc_id with the
same text count as one document (equal rows get equal results), with another text as separate documents;
a null doc_id sorts first; other columns pass through, also when they clash with internal names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.runtime import stored

MIN_RUN = 3
#: Words from which on the pipeline lets a run of fewer lines count.
MIN_WORDS = 20
#: Bytes of keys and line numbers to delete up to which they are broadcast to the documents.
BROADCAST_BYTES = 32 << 20


def _lines(text: Column) -> Column:
    """Array of (at, line): the lines that take part, with their line numbers from 0."""
    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.rtrim(x).alias("line")))
    return F.filter(cut, lambda x: x["line"] != "")


def _keyed(docs: DataFrame, doc_key: str, text_col: str) -> DataFrame:
    """(key, lines): key = (doc key, hash of the text) tells rows apart that repeat a doc key."""
    key = F.struct(F.col(doc_key).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return docs.select(key.alias("key"), _lines(F.col(text_col)).alias("lines"))


def selected_lines(docs: DataFrame, doc_key: str, text_col: str, min_run: int, min_words: int | None = None) -> DataFrame:
    """One row for each selected line: (key, hash, runs).

    `runs` holds the runs that count and contain the line: (start, run_hash, run_check, line numbers).
    """
    short = min_words is not None and min_run > 1
    n_words = F.transform("lines", lambda x: F.regexp_count(x["line"], F.lit(r"\S+")))
    hashed = _keyed(docs, doc_key, text_col).select(
        "key",
        F.transform("lines", lambda x: x["at"]).alias("at"),
        F.transform("lines", lambda x: F.xxhash64(x["line"])).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("check"), x["line"])).alias("g"),
        *([n_words.alias("n_words")] if short else []),
    )
    hashed = hashed.where(F.size("h") >= (1 if short else min_run))
    n_runs = F.size("h") - min_run + 1
    starts = F.when(n_runs > 0, F.sequence(F.lit(0), n_runs - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.slice("h", s + 1, min_run))
    # The least hash of each window, the rightmost of equals: its index, once for adjacent windows that agree.
    least = F.transform(
        windows,
        lambda w, s: s + min_run - F.array_position(F.reverse(w), F.array_min(w)).cast("int"),
    )
    chosen = least
    if short:
        share = -(-min_words // (min_run - 1))
        places = F.transform("n_words", lambda n, i: F.when(n >= share, i))
        chosen = F.concat(least, F.filter(places, lambda i: i.isNotNull()))
    hashed = hashed.select(
        "key", "at", "h", "g", *(["n_words"] if short else []),
        F.array_distinct(chosen).alias("chosen"),
    )
    rows = hashed.select(*[c for c in hashed.columns if c != "chosen"], F.explode("chosen").alias("i"))

    def around(length: int) -> Column:
        """The runs of `length` lines that contain line i and count."""
        first = F.greatest(F.col("i") - (length - 1), F.lit(0))
        last = F.least(F.col("i"), F.size("h") - length)
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        if length < min_run:
            words = lambda s: F.aggregate(F.slice("n_words", s + 1, length), F.lit(0), lambda a, n: a + n)
            starts = F.filter(starts, lambda s: words(s) >= min_words)
        own = {name: (lambda s, c=c: F.xxhash64(F.slice(c, s + 1, length))) for name, c in (("run_hash", "h"), ("run_check", "g"))}
        return F.transform(
            starts,
            lambda s: F.struct(s.alias("start"), *[f(s).alias(name) for name, f in own.items()], F.slice("at", s + 1, length).alias("at")),
        )

    runs = F.concat(*[around(length) for length in range(1 if short else min_run, min_run + 1)])
    marks = rows.select("key", F.element_at("h", F.col("i") + 1).alias("hash"), runs.alias("runs"))
    return marks.where(F.size("runs") > 0) if short else marks


def repeated_lines(
    docs: DataFrame, doc_key: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, min_words: int | None = None
) -> DataFrame:
    """(key, gone): the line numbers of later repeats, one row for each document that has any."""
    marks = stored(selected_lines(docs, doc_key, text_col, min_run, min_words), "line-marks")
    common = stored(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "common-lines")
    # Merge joins at every size: either side grows with the documents.
    runs = marks.join(common.hint("merge"), "hash", "left_semi").select("key", F.explode("runs").alias("run"))
    runs = stored(runs.select("key", "run.*").distinct(), "line-runs")
    place = F.struct("key", "start")
    firsts = runs.groupBy("run_hash", "run_check").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").select("run_hash", "run_check", "first"), "first-runs")
    later = runs.join(firsts.hint("merge"), ["run_hash", "run_check"]).where(place > F.col("first"))
    return later.select("key", F.explode("at").alias("line")).groupBy("key").agg(F.collect_set("line").alias("gone"))


def dedup_lines(
    docs: DataFrame,
    doc_key: str = "doc_id",
    text_col: str = "text",
    min_run: int = MIN_RUN,
    broadcast_bytes: int = BROADCAST_BYTES,
    min_words: int | None = None,
) -> DataFrame:
    """Every row of `docs`, its text without later repeats; adds `n_lines` (lines that take part) and `n_deleted`."""
    gone = stored(repeated_lines(docs, doc_key, text_col, min_run, min_words), "lines-gone")
    # A row takes about 100 bytes besides its numbers.
    small = (gone.agg(F.sum(100 + 4 * F.size("gone"))).first()[0] or 0) <= broadcast_bytes
    gone = F.broadcast(gone) if small else gone.hint("merge")
    # The caller's columns travel in one struct, so their names can't clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row")[text_col]
    same = F.col("row")[doc_key].eqNullSafe(F.col("key.id")) & (F.xxhash64(text) == F.col("key.text_hash"))
    out = rows.join(gone, same, "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i))
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.rtrim(x) != "")), F.lit(0))
    added = {
        text_col: F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.greatest(n_lines, F.lit(0)).cast("long"),
        "n_deleted": F.coalesce(F.greatest(F.size("gone"), F.lit(0)), F.lit(0)).cast("long"),
    }
    own = [added.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return out.select(*own, *[column.alias(name) for name, column in added.items() if name not in docs.columns])


def op3_dedup_lines(spark, sf_dir: str) -> DataFrame:
    """Query: every document without its later repeats of runs of three or more lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_deleted")


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, i, rtrim(line, ' ') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
), part AS (
  SELECT doc_id, i, line, row_number() OVER w AS p, count(*) OVER (PARTITION BY doc_id) AS n
  FROM lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT a.doc_id, a.p, a.line AS l1, b.line AS l2, c.line AS l3
  FROM part a JOIN part b ON a.doc_id = b.doc_id AND b.p = a.p + 1
  JOIN part c ON a.doc_id = c.doc_id AND c.p = a.p + 2
), later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, p) AS seen FROM runs)
  WHERE seen > 1
), gone AS (
  SELECT DISTINCT x.doc_id, x.i FROM part x JOIN later r
  ON x.doc_id = r.doc_id AND x.p BETWEEN r.p AND r.p + 2
)
SELECT d.doc_id,
  CASE WHEN k.n_gone IS NULL THEN d.text ELSE coalesce(s.text, '') END AS text,
  coalesce(m.n, 0)::BIGINT AS n_lines, coalesce(k.n_gone, 0)::BIGINT AS n_deleted
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM part GROUP BY 1) m ON m.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_gone FROM gone GROUP BY 1) k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(r.line, chr(10) ORDER BY l.i) AS text
           FROM lines l JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) r
             ON r.doc_id = l.doc_id AND r.i = l.i
           WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = l.i)
           GROUP BY 1) s ON s.doc_id = d.doc_id
"""
