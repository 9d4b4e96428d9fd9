"""Token ids as directly addressable codes, in files of whole documents in ascending key order.

A file is a Parquet table of segments. A segment holds the ids of consecutive documents and is written as
one self-contained binary value:

    magic `DAC1`, then little-endian u32: n ids, n levels, then for each level
    u32 chunk bits, u32 entries, u32 bytes of chunks, u32 bytes of bitmap, u32 rank entries,
    then for each level its chunks, its continuation bitmap and its rank directory.

Each id is split into chunks, lowest first: `CHUNK_BITS[k]` bits on level k. An entry's bit in the level's
bitmap says whether the id goes on at the next level; its place there is the number of set bits before it,
read from the rank directory (a u32 count before each block of 512 entries) and one popcount within the
block. So any id is found in at most three steps, without decoding its neighbours.

Documents are dealt to buckets by ranges of their key (Spark's range partitions), a bucket is sorted, tokenised
and cut into segments in one streaming pass (memory: one segment, or one document if that is longer), and starts are
added up from per-segment totals when the file is read.

Defined edge results: null texts count as empty, an empty document holds just the end id; rows that repeat
a key are ordered by a hash of the text and each get a row; null keys come first; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.runtime import scratch_path

CHUNK_BITS = (8, 8, 16)
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 20
END_ID = 1
#: Words in one generation of a worker's cache; the last full generation is kept beside the current one.
CACHE_WORDS = 500_000
#: Fixed value: how the tokenizer file cuts words into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Signs at a word's end that the tokenizer's pattern takes as one piece of their own.
SIGNS = ".,;:!?%&$#*|"
#: White space that Python's str.split knows and the tokenizer does not.
CONTROLS = "\x1c\x1d\x1e\x1f"


def pack(ids: np.ndarray) -> bytes:
    """One segment's binary value for an array of u32 ids."""
    rest, levels, bodies = ids.astype(np.uint32), [], []
    for k, bits in enumerate(CHUNK_BITS):
        kind = np.uint8 if bits == 8 else np.uint16
        last = k == len(CHUNK_BITS) - 1
        goes_on = np.zeros(len(rest), bool) if last else rest >= (1 << bits)
        chunks = (rest & ((1 << bits) - 1)).astype(kind).tobytes()
        bitmap = np.packbits(goes_on, bitorder="little").tobytes()
        blocks = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes()
        levels.append(struct.pack("<5I", bits, len(rest), len(chunks), len(bitmap), len(ranks) // 4))
        bodies += [chunks, bitmap, ranks]
        rest = rest[goes_on] >> np.uint32(bits)
        if not len(rest):
            break
    return b"DAC1" + struct.pack("<2I", len(ids), len(levels)) + b"".join(levels) + b"".join(bodies)


class Segment:
    """Random access to the ids of one packed segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.n, n_levels = struct.unpack_from("<2I", blob, 4)
        heads = [struct.unpack_from("<5I", blob, 12 + 20 * k) for k in range(n_levels)]
        at, self.levels = 12 + 20 * n_levels, []
        for bits, entries, n_chunks, n_bitmap, n_ranks in heads:
            kind = np.dtype("u1") if bits == 8 else np.dtype("<u2")
            chunks = np.frombuffer(blob, kind, entries, at)
            bitmap = np.frombuffer(blob, np.uint8, n_bitmap, at + n_chunks)
            ranks = np.frombuffer(blob, "<u4", n_ranks, at + n_chunks + n_bitmap)
            self.levels.append((bits, entries, chunks, bitmap, ranks))
            at += n_chunks + n_bitmap + 4 * n_ranks

    def _rank(self, level: int, at: int) -> int:
        """Set bits of a level's bitmap before entry `at`."""
        _, entries, _, bitmap, ranks = self.levels[level]
        if at >= entries:
            at, block = entries, max(0, (entries - 1) // RANK_BLOCK)
        else:
            block = at // RANK_BLOCK
        if not entries:
            return 0
        low = block * RANK_BLOCK
        bits = np.unpackbits(bitmap[low // 8 : (at + 7) // 8], bitorder="little")[: at - low]
        return int(ranks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        """The id at position i, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (bits, _, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(level, i), shift + bits
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of positions start..end-1; reads just the entries that they need on each level."""
        parts = []
        for level, (bits, _, chunks, bitmap, _) in enumerate(self.levels):
            goes_on = np.unpackbits(bitmap[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            parts.append((bits, chunks[start:end].astype(np.uint32), goes_on))
            if not goes_on.any():
                break
            start, end = self._rank(level, start), self._rank(level, end)
        value = np.zeros(0, np.uint32)
        for bits, chunk, goes_on in reversed(parts):
            here = chunk.copy()
            here[goes_on] |= value << np.uint32(bits)
            value = here
        return value


class WordTokenizer:
    """Ids of whole texts, as the tokenizers library gives them, with a bounded cache of words.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its
    words in turn. Words of ASCII and Latin-1 letters are looked up in the library's model piece by piece;
    any other word, and any text with characters on which the word rule could differ, goes through the
    library's whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words, self.old_words = {}, {}
        self.pieces, self.old_pieces = {}, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in set(printable))
        table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.byte_chars = [table[b] for b in range(256)]

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                plain = piece.isascii() and piece.isprintable()
                shown = piece if plain else "".join(map(self.byte_chars.__getitem__, piece.encode()))
                found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.old_words.get(word)
        if found is None:
            stem = word.rstrip(SIGNS)
            if stem.isalpha() and _is_latin_1(stem):
                found = self._piece(stem) + self._piece(word[len(stem) :]) if len(stem) < len(word) else self._piece(word)
            elif _is_latin_1(word):
                found = b"".join(map(self._piece, PIECES.findall(word)))
            else:
                found = self._library(word)
        if len(word) <= 64:
            if len(self.words) >= CACHE_WORDS:
                self.words, self.old_words = {}, self.words
            self.words[word] = found
        return found

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian u32."""
        if "<|" in text or any(c in text for c in CONTROLS):
            return self._library(text)
        if text.isascii() or _is_latin_1(text := unicodedata.normalize("NFC", text)):
            parts = text.lower().split()
        else:
            # Lower-casing differs between libraries only outside Latin-1; such words stay for the library.
            parts = [w.lower() if _is_latin_1(w) else w for w in text.split()]
        words, word = self.words, self._word
        return b"".join([words.get(w) or word(w) for w in parts])


def _is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


SEGMENT_SCHEMA = (
    "bucket int, segment int, n_docs int, n_tokens long, doc_keys array<bigint>, doc_starts array<int>, blob binary"
)


def _segments(path: str, segment_tokens: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(path)
        end = struct.pack("<I", END_ID)
        bucket, number, keys, parts, total = None, 0, [], [], 0

        def flush():
            sizes = [len(p) // 4 for p in parts]
            ids = np.frombuffer(b"".join(parts), "<u4")
            starts = (np.cumsum(sizes) - sizes).astype(np.int32)
            row = [bucket, number, len(keys), len(ids), list(keys), starts.tolist(), pack(ids)]
            return pd.DataFrame([row], columns=["bucket", "segment", "n_docs", "n_tokens", "doc_keys", "doc_starts", "blob"])

        for batch in batches:
            for b, is_null, key, text in zip(batch["bucket"], batch["no_key"], batch["key"], batch["text"]):
                if parts and (b != bucket or total >= segment_tokens):
                    yield flush()
                    number = number + 1 if b == bucket else 0
                    keys, parts, total = [], [], 0
                elif b != bucket:
                    number = 0
                bucket = b
                ids = tokenizer.encode(text) + end
                keys.append(None if is_null else int(key))
                parts.append(ids)
                total += len(ids) // 4
        if parts:
            yield flush()

    return cut


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS
) -> str:
    """Tokenise `docs` and write the token file at `path`, in ascending key order; returns `path`.

    Buckets are the range partitions of the key and, among equal keys (or none), a hash of the text, as many as the session's
    shuffle partitions; so a key that very many rows share is no single task's.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), "text_hash"]
    rows = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = rows.select(F.spark_partition_id().alias("bucket"), F.col("key").isNull().alias("no_key"), F.coalesce("key", F.lit(0)).alias("key"), "text")
    segments = rows.mapInPandas(_segments(tokenizer_path, segment_tokens), SEGMENT_SCHEMA)
    segments.write.option("compression", "zstd").parquet(path)
    return path


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            packed = Segment(row.blob)
            starts = np.append(np.asarray(row.doc_starts, np.int64), row.n_tokens)
            # None becomes NaN in a float array, so keys go through Python's integers.
            keys = [None if k is None or k != k else int(k) for k in row.doc_keys]
            crcs = [zlib.crc32(packed.slice(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
            yield pd.DataFrame({
                "bucket": np.full(len(keys), row.bucket, np.int32), "segment": np.full(len(keys), row.segment, np.int32),
                "doc_id": pd.array(keys, dtype="Int64"), "at": starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crcs,
            })


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the file.

    Totals of segments are added up within their bucket by a window, totals of buckets (one
    row for each partition) in one small window.
    """
    segments = spark.read.parquet(path)
    totals = segments.select("bucket", "segment", "n_tokens")
    before = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    by_bucket = totals.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    all_before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("bucket", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("offset"))
    starts = within.join(offsets, "bucket").select("bucket", "segment", (F.col("before") + F.col("offset")).alias("from"))
    schema = "bucket int, segment int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    docs = segments.select("bucket", "segment", "n_tokens", "doc_keys", "doc_starts", "blob").mapInPandas(_documents, schema)
    joined = docs.join(starts, ["bucket", "segment"])
    return joined.select("doc_id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: write all documents' ids as a token file in the shared folder and read each document back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)
