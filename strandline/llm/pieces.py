"""SentencePiece encoding and decoding, by an automaton over the pieces and one pass of Viterbi.

An Aho-Corasick automaton of all pieces reads a text once; at each position its output links give the pieces
that end there, longest first, and each relaxes the state of the position from the state where it starts.

What a state keeps depends on the model's kind. In a unigram model it is the best score so far, pieces'
scores added. In a merge (BPE) model a score is a merge's priority, and adding scores gives other
pieces than the merges do; there a transition is admissible if the merges, run on the two neighbouring pieces
alone, leave the boundary between them, and each position has exactly one admissible last piece. Either way
the ids are those of the sentencepiece library for that model.

No piece reaches over the start of a run of blanks or over a line feed, so a text is encoded word by
word, and words are kept in a bounded cache for each worker. Characters that no piece holds become their
UTF-8 bytes' pieces, or the unknown id if the model has none.

Decoding joins the pieces' bytes, turns their blank mark into a blank and cuts the one put before the text.

Defined edge results: null and empty texts have no ids and decode to the empty text; texts of any length are
encoded whole; bytes that are no UTF-8 decode to U+FFFD; other columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = "▁"
CACHE_WORDS = 160_000
SIGNS = ".,;:!?%&$#*|"
UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")


#: Numbers of the trainer's settings in a model file and of the model type in them, and the types known here.
TRAINER, MODEL_TYPE = 2, 3
KINDS = {1: "unigram", 2: "bpe"}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def kind_of(model: bytes) -> str:
    """The kind of a serialized model, `unigram` if it names none."""
    trainer = next((value for field, value in _fields(model) if field == TRAINER), b"")
    number = next((value for field, value in _fields(trainer) if field == MODEL_TYPE), 1)
    if number not in KINDS:
        raise ValueError(f"model type {number} is neither unigram nor BPE")
    return KINDS[number]


class Pieces:
    """Encoder and decoder of one model file; its `kind`, `bpe` or `unigram`, is read from the file if not given."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.piece_size()
        self.kind, self.unknown = kind or kind_of(model.serialized_model_proto()), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        self.scores = [model.get_score(i) for i in range(size)]
        self.byte_ids = [0] * 256
        usual, self.surface = {}, []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif i == self.unknown:
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(name.replace(BLANK, " ").encode())
                if not model.is_unused(i):
                    usual[name] = i
        self.has_bytes = any(self.byte_ids)
        self.piece_of, self.name_of = usual, names
        self.lengths = [len(n) for n in names]
        self.letters = {n for n in usual if len(n) == 1}
        self.automaton = ahocorasick.Automaton()
        for name, i in usual.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.pairs = {n[k : k + 2] for n in usual for k in range(len(n) - 1)}
        self.stretches, self.old_stretches = {}, {}
        self.inner, self.old_inner, self.first, self.old_first = {}, {}, {}, {}
        self.after: list[dict[int, bool]] = [{} for _ in names]  # what may follow a piece
        self.known_borders = 0
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.alone = bytearray([2]) * size  # 2: not known yet
        self.lowest_merge = -1e8  # pieces below it share one score; ties among them are left to the merges
        self.line_feed = self.whole("\n")

    def merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text of known letters: the best scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.piece_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces of which the last merge makes piece i; None for a letter or a piece that merges don't reach."""
        if i not in self.halves:
            name, parts = self.name_of[i], list(self.name_of[i])
            while len(parts) > 2:
                scored = [(self.scores[j], -k) for k in range(len(parts) - 1) if (j := self.piece_of.get(parts[k] + parts[k + 1])) is not None]
                if not scored:
                    break
                k = -max(scored)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[i] = (self.piece_of[parts[0]], self.piece_of[parts[1]]) if len(name) > 1 and len(parts) == 2 else None
        return self.halves[i]

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave the boundary between two pieces.

        The pieces at the boundary are taken apart, the one made last first; a pair that
        could be merged before either was made would have crossed the boundary.
        """
        found = self.after[left].get(right)
        if found is None:
            self.known_borders += 1
            if self.known_borders > 2 * CACHE_WORDS:
                self.known_borders = 0
                for one in self.after:
                    one.clear()
            if self.scores[left] < self.lowest_merge or self.scores[right] < self.lowest_merge:
                a, b = self.name_of[left], self.name_of[right]
                found = self.merged(a + b) == [a, b]
            else:
                found = self._apart(left, right)
            self.after[left][right] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        names, scores, piece_of = self.name_of, self.scores, self.piece_of
        # When a piece of a side is made, as a score; a letter is there from the start.
        made_left, made_right = self._made(left), self._made(right)
        until_left = until_right = float("-inf")
        while True:
            both = piece_of.get(names[left] + names[right])
            # The pair stands side by side until the earlier of the two merges that take them up.
            if both is not None:
                score = scores[both]
                # Of equal scores the leftmost is merged first: the left side's own merge, then the boundary's.
                if score > until_left and score >= until_right:
                    return False
            if made_left == made_right == float("inf"):
                return True
            if made_left <= made_right:
                until_left = made_left
                left = self._halves(left)[1]
                made_left = self._made(left)
            else:
                until_right = made_right
                right = self._halves(right)[0]
                made_right = self._made(right)

    def _made(self, i: int) -> float:
        return float("inf") if self.lengths[i] == 1 else self.scores[i]

    def merged_alone(self, i: int) -> bool:
        """Whether the merges of a piece's own letters give the piece."""
        if self.alone[i] == 2:
            self.alone[i] = self.merged(self.name_of[i]) == [self.name_of[i]]
        return self.alone[i] == 1

    def _known(self, text: str) -> list[int]:
        """Ids of a text of known letters: one pass over the automaton's outputs."""
        n, lengths = len(text), self.lengths
        if self.kind == "unigram":
            best, last = [0.0] + [float("-inf")] * n, [-1] * (n + 1)
            for end, i in self.automaton.iter(text):
                start = end + 1 - lengths[i]
                score = best[start] + self.scores[i]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, i
        else:
            last, alone, after = [-1] * (n + 1), self.alone, self.after
            for end, i in self.automaton.iter(text):
                end += 1
                if last[end] >= 0:
                    continue
                start = end - lengths[i]
                if start == 0:
                    if alone[i] == 2 and self.merged_alone(i) or alone[i] == 1:
                        last[end] = i
                elif (before := last[start]) >= 0:
                    stays = after[before].get(i)
                    if self.stays(before, i) if stays is None else stays:
                        last[end] = i
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        return ids[::-1]

    def _stretch(self, text: str) -> bytes:
        """Ids of a stretch of known letters, through a bounded cache."""
        found = self.stretches.get(text) or self.old_stretches.get(text)
        if found is None:
            found = array("i", self._known(text)).tobytes()
            if len(text) <= 64:
                if len(self.stretches) >= CACHE_WORDS // 2:
                    self.stretches, self.old_stretches = {}, self.stretches
                self.stretches[text] = found
        return found

    def whole(self, unit: str) -> bytes:
        """Ids (int32) of a unit.

        It is cut between letters that no piece holds side by side, as no piece or merge reaches over such a place; the
        stretches go through the automaton, characters that no piece holds become bytes.
        """
        letters, pairs = self.letters, self.pairs
        stem = unit.rstrip(SIGNS)
        if stem and letters.issuperset(unit):  # the usual word, with or without signs at its end
            k = len(stem)
            if k == len(unit):
                return self._stretch(unit)
            if unit[k - 1 : k + 1] not in pairs:
                return self._stretch(stem) + self._stretch(unit[k:])
        parts: list[bytes] = []
        begin, unknown_before = 0, False
        for k, c in enumerate(unit):
            if c not in letters:
                if begin < k:
                    parts.append(self._stretch(unit[begin:k]))
                    unknown_before = False
                begin = k + 1
                if self.has_bytes:
                    parts.append(array("i", [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]).tobytes())
                elif not unknown_before:
                    parts.append(array("i", [self.unknown]).tobytes())
                unknown_before = True
            elif begin < k and unit[k - 1 : k + 1] not in pairs:
                parts.append(self._stretch(unit[begin:k]))
                begin, unknown_before = k, False
        if begin < len(unit):
            parts.append(self._stretch(unit[begin:]))
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def _inner(self, word: str) -> bytes:
        found = self.old_inner.get(word)
        if found is None:
            found = self.whole(BLANK + word)
        if len(word) <= 64:
            if len(self.inner) >= CACHE_WORDS:
                self.inner, self.old_inner = {}, self.inner
            self.inner[word] = found
        return found

    def _first(self, word: str) -> bytes:
        found = self.old_first.get(word)
        if found is None:
            found = self.whole(word)
        if len(word) <= 64:
            if len(self.first) >= CACHE_WORDS // 4:
                self.first, self.old_first = {}, self.first
            self.first[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as int32."""
        if not text:
            return np.zeros(0, np.int32)
        parts: list[bytes] = []
        if BLANK in text or "  " in text or " \n" in text or text[-1] == " " or text[0] == " ":
            marked = (BLANK + text).replace(" ", BLANK)
            parts = [self.line_feed if u == "\n" else self._first(u) for u in UNIT.findall(marked)]
            return np.frombuffer(b"".join(parts), np.int32)
        inner, miss = self.inner, self._inner
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append(self.line_feed)
            words = line.split(" ")
            if k and words[0]:
                parts.append(self.first.get(words[0]) or self._first(words[0]))
            elif not k:
                # The text's own first word gets the blank put before the text; an empty one is just that blank.
                parts.append((inner.get(words[0]) or miss(words[0])) if words[0] else self._first(BLANK))
            parts += [inner.get(w) or miss(w) for w in words[1:]]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of an array of ids."""
        text = b"".join([self.surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_PIECES: dict[tuple[str, str | None], Pieces] = {}


def _pieces(path: str, kind: str | None) -> Pieces:
    if (path, kind) not in _PIECES:
        _PIECES[path, kind] = Pieces(path, kind)
    return _PIECES[path, kind]


def encode_texts(docs: DataFrame, model_path: str, kind: str | None = None, text: str = "text") -> DataFrame:
    """Every row of `docs` with `ids`."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        encode = _pieces(model_path, kind).encode
        return pd.Series([encode(t) for t in texts], dtype=object)

    return docs.withColumn("ids", encoded(text))


def decode_ids(rows: DataFrame, model_path: str, kind: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row of `rows` with the text of its ids."""

    @F.pandas_udf("string")
    def decoded(arrays: pd.Series) -> pd.Series:
        decode = _pieces(model_path, kind).decode
        return pd.Series(["" if a is None else decode(np.asarray(a)) for a in arrays], dtype=object)

    return rows.withColumn(out, decoded(ids))


def encoded_documents(docs: DataFrame, model_path: str, kind: str | None = None, slice_docs: int = 250) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): ids, and whether decoding them gives the text again.

    One pass; results leave a task in slices of `slice_docs` documents, so that no batch of long id arrays builds up.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model_path, kind)
        for batch in batches:
            for at in range(0, len(batch), slice_docs):
                part = batch.iloc[at : at + slice_docs]
                ids = [pieces.encode(t) for t in part["text"]]
                same = [pieces.decode(x) == t for x, t in zip(ids, part["text"])]
                yield pd.DataFrame({"key": part["key"], "ids": pd.Series(ids, dtype=object, index=part.index), "n_ids": [len(x) for x in ids], "round_trip": same})

    # A struct keeps null ids out of float columns.
    rows = docs.select(F.struct(F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    found = rows.mapInPandas(work, f"key struct<doc_id:{id_type}>, ids array<int>, n_ids bigint, round_trip boolean")
    return found.select("key.doc_id", "ids", "n_ids", "round_trip")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the piece ids of every document, decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
