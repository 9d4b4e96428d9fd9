"""Media columns: documents as interleaved sequences of text and media references, with stored payloads.

A page's HTML is parsed into an ordered array of segments (position, kind, text, digest, caption, n_bytes):
text blocks and `<img src="sha256:...">` references, whose `<figcaption>` is the caption. Media are
stored by the digest of their stored form. A reference is resolved by a join on the digest; positions and captions stay in
the segment, so the order of a document never depends on the join.

A document's page (`document_pages`) has a heading, a paragraph for each line of the text and, after the first of them, the
figure of the document's media with its caption.

Texts become media losslessly: UTF-8 bytes, zero bytes up to a positive multiple of 64, stored as a
binary grey map (`P5`), 64 samples of 8 bits in a row. Digest, size and features are computed from the stored bytes as
read back.

`resolve` gives the features of each reference, and only features, never payloads, go through its shuffle: they are computed in
the scan of the stored table and brought down to one row for each digest by an aggregate that combines on the map side.
`interleaved` gives whole sequences: every text and media segment with its place, references with their stored bytes.

Defined edge results: a null text counts as empty, whose payload is 64 zero bytes; equal texts have equal
media; a reference whose digest is not stored keeps its place with null media columns; null HTML
has no segments; other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.runtime import scratch_path, stored

ROW = 64
SCHEME = "sha256:"
#: Elements that begin a new text block, and elements whose text is not shown.
BLOCKS = frozenset("article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
HIDDEN = frozenset("script style template noscript".split())
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,n_bytes:bigint>>"


def grey_map(text: Column) -> Column:
    """The stored form of a text."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.ceil(F.octet_length(raw) / ROW), F.lit(1)).cast("int")
    header = F.concat(F.lit(f"P5\n{ROW} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return F.concat(header, F.rpad(raw, rows * ROW, F.lit(b"\x00")))


class _Segments(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption_of: dict | None = None
        self.in_caption = False

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text and self.in_caption and self.caption_of is not None:
            self.caption_of["caption"] = text
        elif text:
            self._add("text", text=text)

    def _add(self, kind: str, **values) -> dict:
        empty = {"text": None, "digest": None, "caption": None, "n_bytes": None}
        self.found.append({"position": len(self.found), "kind": kind} | empty | values)
        return self.found[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS or tag == "img":
            self._flush()
        if tag == "figure":
            self.caption_of = None
        elif tag == "figcaption":
            self.in_caption = True
        elif tag == "img":
            a = dict(attrs)
            source, size = a.get("src") or "", a.get("data-bytes") or ""
            digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else None
            self.caption_of = self._add(
                "media", text=None if digest else source, digest=digest, caption=a.get("alt"),
                n_bytes=int(size) if size.isdecimal() else None,
            )

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self._flush()
        if tag == "figcaption":
            self.in_caption = False
        elif tag == "figure":
            self.caption_of = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words.append(data)


def segments_of(html: str | None) -> list[dict]:
    """The ordered segments of one page."""
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.found


def parse_pages(pages: DataFrame, html: str = "html", out: str = "segments") -> DataFrame:
    """Every row of `pages` with its ordered segments instead of its HTML."""

    @F.pandas_udf(SEGMENTS)
    def parse(htmls: pd.Series) -> pd.Series:
        return htmls.map(segments_of)

    return pages.withColumn(out, parse(html)).drop(html)


def text_feature(samples: np.ndarray) -> str:
    """Mean, standard deviation and entropy of 8-bit samples, and their shares in sixteen ranges (in thousandths)."""
    counts = np.bincount(samples, minlength=256)
    share = counts / max(1, len(samples))
    level = np.arange(256)
    mean = float(share @ level)
    spread = float(np.sqrt(max(0.0, share @ (level - mean) ** 2)))
    some = share[share > 0]
    entropy = max(0.0, float(-(some * np.log2(some)).sum()))
    ranges = np.rint(share.reshape(16, 16).sum(axis=1) * 1000).astype(int)
    return f"{mean:.4f};{spread:.4f};{entropy:.4f};" + ",".join(map(str, ranges))


FEATURE_SCHEMA = (
    "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
)


def media_features(media: DataFrame) -> DataFrame:
    """One row for each digest of the stored table (digest, media), computed from the stored bytes."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, blob in zip(batch["digest"], batch["media"]):
                magic, size, most, payload = blob.split(b"\n", 3)
                width, height = map(int, size.split())
                if magic != b"P5" or most != b"255" or len(payload) != width * height:
                    raise ValueError(f"{digest}: not a grey map of 8-bit samples")
                rows.append((
                    digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
                    len(blob), hashlib.sha256(blob).hexdigest(), text_feature(np.frombuffer(payload, np.uint8)),
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURE_SCHEMA.split(", ")])

    found = media.select("digest", "media").mapInPandas(compute, FEATURE_SCHEMA)
    columns = [c for c in found.columns if c != "digest"]
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in columns])


def resolve(pages: DataFrame, features: DataFrame, key: str = "doc_id", segments: str = "segments") -> DataFrame:
    """One row for each media segment: key, position, caption, n_bytes, digest, n_segments, texts_sha256, and the media's columns."""
    texts = F.transform(F.filter(segments, lambda s: s["kind"] == "text"), lambda s: s["text"])
    media = F.filter(segments, lambda s: s["kind"] == "media")
    whole = pages.select(key, F.size(segments).alias("n_segments"), F.sha2(F.array_join(texts, "\n"), 256).alias("texts_sha256"), media.alias("m"))
    flat = whole.select(key, "n_segments", "texts_sha256", F.explode("m").alias("s"))
    flat = flat.select(key, "s.position", "s.caption", "s.n_bytes", "s.digest", "n_segments", "texts_sha256")
    return stored(flat, "media-references").join(stored(features, "media-features"), "digest", "left")


def interleaved(pages: DataFrame, media: DataFrame, key: str = "doc_id", segments: str = "segments") -> DataFrame:
    """One row for each segment, text and media alike: key, position, kind, text, caption, digest, media.

    `media` holds the stored bytes of a reference's digest, looked up in the table `media` (digest, media); null for
    texts and for references that are not stored. Ordered by key and position the rows are the sequences. A page
    without segments has no row. Texts don't pass the join, and of equal media one copy does.
    """
    flat = pages.select(F.col(key), F.explode(segments).alias("s"))
    flat = stored(flat.select(key, "s.position", "s.kind", "s.text", "s.caption", "s.digest"), "segments")
    payloads = stored(media.where("digest is not null").groupBy("digest").agg(F.first("media").alias("media")), "payloads")
    columns = [*flat.columns, "media"]
    texts = flat.where("digest is null").withColumn("media", F.lit(None).cast("binary"))
    references = flat.where("digest is not null").join(payloads, "digest", "left")
    return texts.select(columns).unionByName(references.select(columns))


def with_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, media) of each document, written to the shared folder and read back.

    Copies of a text are stored with each copy; what is read per digest is the same.
    """
    named = docs.select(F.col(key).alias("doc_id"), grey_map(F.col(text)).alias("media"))
    path = scratch_path(docs.sparkSession, "media")
    named.select("doc_id", F.sha2("media", 256).alias("digest"), "media").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def document_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, html): each document as an interleaved page, which refers to its media by digest."""
    safe = F.coalesce(F.col(text), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    figure = F.format_string(
        f'<figure><img src="{SCHEME}%s" data-bytes="%d"><figcaption>Text of %d bytes</figcaption></figure>', "digest", "n", "n"
    )
    lines = F.split("safe", "\n")
    html = F.concat(
        F.lit("<article><h1>Document</h1><p>"), lines[0], F.lit("</p>"), figure,
        F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""),
        F.lit("</article>"),
    )
    n = F.coalesce(F.octet_length(text), F.lit(0))
    rows = docs.select(F.col(key).alias("doc_id"), n.alias("n"), F.sha2(grey_map(F.col(text)), 256).alias("digest"), safe.alias("safe"))
    return rows.select("doc_id", html.alias("html"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's media reference with what its stored media hold, and the sequence it stands in.

    `position` is the reference's place among the `n_segments` of the document's page, `texts_sha256` the digest of the
    page's text segments, in order, joined by line feeds.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = with_media(docs)
    pages = parse_pages(document_pages(docs))
    found = resolve(pages, media_features(written))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "position", "caption", "n_segments", "texts_sha256",
    )
