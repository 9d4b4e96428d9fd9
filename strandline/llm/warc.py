"""WARC: records written and read, and not-modified revisits resolved.

A revisit (HTTP 304) has no body. It is resolved by an as-of join on the canonical URL to the latest
earlier full response; the validators must agree (entity tags by weak comparison where both sides have
one, else the last-modified dates), and the headers that a 304 may update replace the stored ones.

What a revisit finds depends on its URL and time only, so the as-of join runs on distinct (URL, time)
instants and no record id has to be unique. It survives a URL with any share of the captures: instants are
range-partitioned by URL and time, so such a URL spreads over many partitions; within a partition the last
response is found by a window; the last response of each (URL, partition) is carried on over the partitions
by a second window whose groups have at most one row for each partition. Joins are between written tables,
so an instant that very many revisits refer to is split by adaptive execution. Payloads are digested where
they are parsed and do not take part.

Defined edge results: a response at the very time of a revisit is not earlier; of responses of one URL and time
the one with the greatest record id counts, then the one with the greatest digest; without an earlier response the
status is `no_response`, with disagreeing validators `validator_mismatch`, without a validator on both sides
`no_validator`; repeated revisits are resolved one by one, each to one row; null or malformed URLs have the
canonical URL of the empty string; a capture without a readable date is neither earlier nor later than any other, so such a
revisit has `no_response`; a record without an id has a null id; header names are compared in lower case, repeated
headers are joined by a comma; null files hold no records. Bytes that are no whole record are skipped up to the next
beginning of a record, and reported as one capture of kind `damaged`, whose `n_bytes` counts them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import stored

#: Headers of a 304 that never replace stored ones.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
]
#: Fixed value: query parameters that only track visits.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.`, user and default port; path without trailing slashes; sorted query without tracking."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    for pattern in ("^[^@]*@", ":(80|443)$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, pattern, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def record(kind: str, record_id: Column, uri: Column, at: Column, http: Column, body: Column | None = None) -> Column:
    """The bytes of one WARC/1.1 record: `http` is the status line and headers, each line ended by CR LF.

    `at` is in seconds and written in UTC whatever the session's zone. A null part is written as nothing.
    """
    content = F.concat(http.cast("binary"), F.lit("\r\n").cast("binary"), *([F.coalesce(body.cast("binary"), F.lit(b""))] if body is not None else []))
    # A timestamp without zone: neither its arithmetic nor its text depends on the session.
    date = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=at)).cast("string")
    date = F.coalesce(F.concat(F.translate(date, " ", "T"), F.lit("Z")), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def parse_block(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers (names in lower case) of a header block."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return lines[0], headers


#: How a record begins and what stands behind it.
FIRST_LINE, RECORD_END = re.compile(rb"WARC/[0-9.]+\r\n"), b"\r\n\r\n"


def parse_warc(blob: bytes) -> Iterator[tuple[dict[str, str], str, dict[str, str], bytes]]:
    """(WARC headers, HTTP status line, HTTP headers, body) of each record.

    Bytes skipped because they are no whole record come out as one entry: ({"warc-type": "damaged"}, "", {}, the bytes).
    """
    at, skipped = 0, None
    while at < len(blob):
        whole = None
        end = blob.find(RECORD_END, at)
        if end >= 0 and FIRST_LINE.match(blob, at):
            _, warc = parse_block(blob[at:end])
            size = warc.get("content-length", "")
            begin = end + 4
            stop = begin + int(size) if size.isascii() and size.isdecimal() else len(blob) + 1
            if stop == len(blob) or blob.startswith(RECORD_END, stop):
                whole = begin, stop
        if whole is None:
            skipped = at if skipped is None else skipped
            found = FIRST_LINE.search(blob, at + 1)
            at = found.start() if found else len(blob)
            continue
        if skipped is not None:
            yield {"warc-type": "damaged"}, "", {}, blob[skipped:at]
            skipped = None
        begin, stop = whole
        cut = blob.find(RECORD_END, begin, stop)
        cut = stop if cut < 0 else cut
        status, http = parse_block(blob[begin:cut])
        yield warc, status, http, blob[min(cut + 4, stop) : stop]
        at = stop
        while blob[at : at + 1] in (b"\r", b"\n"):
            at += 1
    if skipped is not None:
        yield {"warc-type": "damaged"}, "", {}, blob[skipped:]


CAPTURES = (
    "record_id string, kind string, uri string, at string, status int, headers map<string,string>, n_bytes bigint, payload_sha256 string"
)


def read_captures(files: DataFrame, warc: str = "warc") -> DataFrame:
    """One row for each response or revisit record of a column of WARC bytes, with the body's size and digest, and for each damaged stretch.

    A record id is what follows the last colon of the record's id.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for blob in batch[warc]:
                for head, status, http, body in parse_warc(blob or b""):
                    if head.get("warc-type") not in ("response", "revisit", "damaged"):
                        continue
                    name = head.get("warc-record-id", "").strip("<>").rpartition(":")[2]
                    code = (status.split(" ")[1:2] or [""])[0]
                    rows.append((
                        name or None, head["warc-type"], head.get("warc-target-uri"), head.get("warc-date"),
                        int(code) if re.fullmatch("[0-9]{3}", code) else None, http, len(body), hashlib.sha256(body).hexdigest(),
                    ))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURES.split(", ")])
            yield out.astype({"status": "Int32"})

    captures = files.select(warc).mapInPandas(parse, CAPTURES)
    return captures.withColumn("at", F.unix_timestamp(F.try_to_timestamp("at"))).withColumn("url", canonical_url(F.col("uri")))


def latest_earlier_response(revisits: DataFrame, responses: DataFrame) -> DataFrame:
    """(url, at, response_at): for each instant of a revisit the time of the last response before it, null without one.

    Both are written tables of instants (url, at).
    """
    asked = revisits.select("url", "at", F.lit(0).alias("full")).distinct()
    events = asked.union(responses.select("url", "at", F.lit(1))).where("at is not null")
    order = ["at", "full"]
    dealt = events.repartitionByRange("url", *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "captures-by-time")
    response = F.when(F.col("full") == 1, F.col("at"))
    local = Window.partitionBy("part", "url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("response_at", F.last(response, ignorenulls=True).over(local)).where("full = 0")
    seen = stored(seen.select("url", "at", "part", "response_at"), "revisits-seen")
    ends = dealt.groupBy("url", "part").agg(F.max(response).alias("end"))
    over = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "part", F.last("end", ignorenulls=True).over(over).alias("carried"))
    carried = stored(carried.where("carried is not null"), "responses-carried")
    found = seen.join(carried, ["url", "part"], "left")
    return found.select("url", "at", F.coalesce("response_at", "carried").alias("response_at"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url, at, status, response_id, n_bytes, payload_sha256, headers (merged, a map)."""
    captures = stored(captures, "captures")
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    full = captures.where("kind = 'response' and status = 200 and at is not null")
    entries = F.array_sort(F.map_entries(headers))
    found = F.max_by(F.struct("record_id", headers.alias("old"), "n_bytes", "payload_sha256"), F.struct("record_id", "payload_sha256", "n_bytes", entries))
    full = stored(full.groupBy("url", "at").agg(found.alias("r")), "responses")
    revisits = captures.where("kind = 'revisit'").select("record_id", "url", "at", headers.alias("new"))
    found = stored(latest_earlier_response(revisits, full).where("response_at is not null"), "revisits-found")
    revisits = stored(revisits.join(found, ["url", "at"], "left"), "revisits")
    full = full.select("url", F.col("at").alias("response_at"), F.col("r.record_id").alias("response_id"), "r.old", "r.n_bytes", "r.payload_sha256")
    both = revisits.join(full, ["url", "response_at"], "left")

    def agree(name: str) -> Column:
        weak = [F.regexp_replace(F.col(side)[name], "^W/", "") for side in ("new", "old")]
        return weak[0] == weak[1]

    by_tag, by_date = agree("etag"), agree("last-modified")
    status = (
        F.when(F.col("old").isNull(), "no_response")
        .when(F.coalesce(by_tag, by_date).isNull(), "no_validator")
        .when(F.coalesce(by_tag, by_date), "resolved")
        .otherwise("validator_mismatch")
    )
    permitted = F.map_filter("new", lambda k, _: ~k.isin(KEPT_HEADERS))
    untouched = F.map_filter("old", lambda k, _: ~F.map_contains_key(permitted, k))
    both = both.withColumn("status", status)
    good = F.col("status") == "resolved"
    return both.select(
        "record_id", "url", "at", "status",
        *[F.when(good, F.col(c)).alias(c) for c in ("response_id", "n_bytes", "payload_sha256")],
        F.when(good, F.map_concat(untouched, permitted)).alias("headers"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """WARC bytes made from a table of pages: each page's full response, and a later revisit of it.

    Every fifth page's revisit carries the tag of another version, every seventh page has no tag but a date, and
    the revisit of every eleventh page comes before its response. Null HTML counts as empty; a page without
    an id has captures without ids and dates.
    """
    number, day = F.col("page_id"), 86_400
    html = F.coalesce("html", F.lit(""))
    at = F.lit(1_700_000_000) + number % 1_000_000_000 * 60
    revisited = at + F.when(number % 11 == 0, -day).otherwise(30 * day)
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    tag_line = F.when(number % 7 == 0, "").otherwise(F.concat(F.lit("ETag: "), tag, F.lit("\r\n")))
    new_tag = F.when(number % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    new_tag_line = F.when(number % 7 == 0, "").otherwise(F.concat(F.lit("ETag: "), new_tag, F.lit("\r\n")))
    changed = F.coalesce(F.concat(F.lit("Last-Modified: "), (at - day).cast("string"), F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nCache-Control: max-age=60\r\nServer: a\r\n"),
        F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), tag_line, changed,
    )
    http_304 = F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\nCache-Control: max-age=3600\r\nContent-Length: 0\r\nDate: "),
        F.coalesce(revisited.cast("string"), F.lit("")), F.lit("\r\n"), new_tag_line, changed,
    )
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    name = number.cast("string")
    both = F.concat(
        record("response", F.concat(name, F.lit("/response")), F.col("url"), at, http, html),
        record("revisit", F.concat(name, F.lit("/revisit")), again, revisited, http_304),
    )
    return pages.select(both.alias("warc"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every revisit of the captures of `pages`, resolved, with page ids instead of record ids.

    An unresolved revisit has -1 for the response's page and size; a revisit without a date has -1 for its time.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve_revisits(read_captures(page_captures(pages)))
    headers = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))

    def page_of(record_id: str) -> Column:
        return F.substring_index(record_id, "/", 1).try_cast("bigint")

    return found.select(
        page_of("record_id").alias("page_id"), "url", F.coalesce("at", F.lit(-1)).alias("revisit_at"), "status",
        F.coalesce(page_of("response_id"), F.lit(-1)).alias("response_page_id"),
        F.coalesce("n_bytes", F.lit(-1)).alias("n_bytes"), "payload_sha256", F.array_join(headers, "\n").alias("headers"),
    )


OP10_SQL = r"""
WITH plain AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), cut AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid)(=|$)'))), '&') AS query
  FROM plain
), page AS (
  SELECT page_id, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url,
    1700000000 + page_id % 1000000000 * 60 AS ts, '"' || md5(html)[1:16] || '"' AS tag,
    strlen(html) AS n_bytes, sha256(html) AS payload_sha256
  FROM cut
), revisit AS (
  SELECT page_id, url, ts + CASE WHEN page_id % 11 = 0 THEN -86400 ELSE 2592000 END AS ts, ts - 86400 AS changed,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END AS tag FROM page
), joined AS (
  SELECT r.*, p.page_id AS response_page_id, p.ts AS response_at, p.n_bytes, p.payload_sha256,
    CASE WHEN p.page_id % 7 = 0 THEN NULL ELSE p.tag END AS old_tag
  FROM revisit r LEFT JOIN (SELECT * FROM page WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, ts ORDER BY page_id || '/response' DESC, payload_sha256 DESC, n_bytes DESC) = 1) p
    ON p.url = r.url AND p.ts = (SELECT max(q.ts) FROM page q WHERE q.url = r.url AND q.ts < r.ts)
), judged AS (
  SELECT *, CASE WHEN response_page_id IS NULL THEN 'no_response'
    WHEN coalesce(replace(tag, 'W/', '') = old_tag, changed = response_at - 86400) THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM joined
)
SELECT page_id, url, coalesce(ts, -1) AS revisit_at, status,
  CASE WHEN status = 'resolved' THEN response_page_id ELSE -1 END AS response_page_id,
  CASE WHEN status = 'resolved' THEN n_bytes ELSE -1 END AS n_bytes,
  CASE WHEN status = 'resolved' THEN payload_sha256 END AS payload_sha256,
  CASE WHEN status = 'resolved' THEN array_to_string(list_sort(list_filter([
    'cache-control: max-age=3600', 'content-length: ' || n_bytes, 'content-type: text/html; charset=utf-8',
    'date: ' || ts, 'etag: ' || coalesce(tag, old_tag), 'last-modified: ' || changed, 'server: a'], lambda h: h IS NOT NULL)), chr(10)) END AS headers
FROM judged
"""
