"""SentencePiece encoding and decoding as a streaming Viterbi pass.

The given vocabulary is of the merging kind (BPE with byte fallback), for which the best path isn't that of the
highest sum of scores, so the pass keeps, for each boundary between characters, the one piece that can end
there: of the pieces that end at a boundary exactly one can follow the survivor at its own start, namely the
one for which merging the two side by side gives just these two. Ids then equal those of merging the whole
text, yet only a window is held: as a piece has at most ``longest`` characters, later pieces begin in the last
``longest`` boundaries, and as soon as the paths back from all of them run through one boundary, everything
before it is committed.

No piece reaches over a space that follows another character, so all paths converge there; what lies between
two such places is encoded once per worker and remembered, within a bounded store. Normalisation is the
model's: spaces become U+2581, one is put in front; nothing else changes. Decoding reverses that; a text that
itself holds U+2581 gets spaces there, as with any such model.

Null and empty texts have no ids. The vocabulary (bounded by the model) is read on the driver and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm import words as W
from sieveline.llm.rows import fields, whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches that a worker remembers at least (twice as many at most), pairs of pieces, and the longest stretch.
REMEMBERED = 300_000
PAIRS = 1_000_000
LONGEST_REMEMBERED = 64
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Vocabulary:
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    surfaces: list[bytes]  # of each id; control pieces have none
    longest: int
    _pairs: dict = field(default_factory=dict, repr=False)
    _found: object = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, surfaces = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append(b"")
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                surfaces.append(piece.replace(SPACE, " ").encode())
        return cls(ids, scores, byte_ids, surfaces, max(map(len, ids)))

    @property
    def automaton(self):
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for piece in self.ids:
                self._found.add_word(piece, (len(piece), piece))
            self._found.make_automaton()
        return self._found

    def __getstate__(self):
        return self.__dict__ | {"_pairs": {}, "_found": None}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: always the best-scored pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, one: str, two: str) -> bool:
        """Whether two pieces stay apart when they stand side by side."""
        key = (one, two)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(one + two) == ([one, two] if one else [two])
        return known

    def piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]


class Stream:
    """Encodes characters as they come; holds no more than the last pieces' window and open paths."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the committed boundary on
        self.start = [0]  # of the surviving piece that ends at each boundary; the first is the committed one
        self.before = ""  # the piece that ends at the committed boundary
        self.wait = 2 * vocabulary.longest

    def feed(self, characters: str) -> Iterator[int]:
        for c in characters:
            self.text += c
            self.start.append(self.survivor(len(self.text)))
            if len(self.text) >= self.wait:
                yield from self.commit(self.meeting())
                self.wait = len(self.text) + self.v.longest

    def survivor(self, end: int) -> int:
        text = self.text
        for begin in range(max(0, end - self.v.longest), end):
            piece = text[begin:end]
            if end - begin > 1 and piece not in self.v.ids:
                continue
            if begin:
                last = text[self.start[begin] : begin]
            else:
                last = self.before
            if self.v.follows(last, piece):
                return begin
        raise AssertionError("every boundary has a survivor")

    def meeting(self) -> int:
        """The last boundary that the paths from all of the window's boundaries run through."""
        paths = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(paths) > 1:
            latest = max(paths)
            paths.remove(latest)
            paths.add(self.start[latest])
        return paths.pop()

    def commit(self, boundary: int) -> list[int]:
        if not boundary:
            return []
        pieces, at = [], boundary
        while at:
            pieces.append(self.text[self.start[at] : at])
            at = self.start[at]
        self.before = pieces[0]
        self.text = self.text[boundary:]
        # A window's piece may begin before the boundary only if no later path uses it.
        self.start = [0] + [max(s - boundary, 0) for s in self.start[boundary + 1 :]]
        return [i for piece in reversed(pieces) for i in self.v.piece_ids(piece)]

    def close(self) -> list[int]:
        return self.commit(len(self.text))


class Encoder:
    """Encodes texts, remembering stretches, and pairs of pieces, as long as it lives."""

    def __init__(self, vocabulary: Vocabulary):
        # The vocabulary outlives the task in its worker; what one task remembers must not.
        vocabulary.automaton
        self.v = replace(vocabulary, _pairs={})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def short(self, text: str) -> bytes:
        """The same pass over a stretch that fits the window, where nothing is committed before its end."""
        v = self.v
        known, pairs, follows = v.ids, v._pairs, v.follows
        ends: list[str] = [""]  # the surviving piece at each boundary
        for at, (size, piece) in v.automaton.iter(text):  # pieces by their end, the longest first
            n = len(ends)
            if n > at + 1:
                continue
            while n <= at:  # a character that is in no piece stands alone
                ends.append(text[n - 1])
                n += 1
            last = ends[at + 1 - size]
            fits = pairs.get((last, piece))
            if fits is None:
                fits = follows(last, piece)
            if fits:
                ends.append(piece)
        ends.extend(text[len(ends) - 1 :])
        out, at = [], len(text)
        while at:
            piece = ends[at]
            found = known.get(piece)
            out.append([found] if found is not None else v.piece_ids(piece))
            at -= len(piece)
        return np.array([i for ids in reversed(out) for i in ids], dtype=np.int32).tobytes()

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch as 32-bit numbers."""
        if len(text) < 2 * self.v.longest:
            return self.short(text)
        stream = Stream(self.v)
        ids = [*stream.feed(text), *stream.close()]
        return np.array(ids, dtype=np.int32).tobytes()

    def word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.stretch(SPACE + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:  # what isn't met again while as many others are is forgotten
                self.older = dict(self.known)
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        known, word = self.known, self.word
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            stretches = _STRETCH.findall(SPACE + text.replace(" ", SPACE))
            return b"".join([(known.get(s[1:]) or word(s[1:])) if s[0] == SPACE and s[1:2] not in ("", SPACE) else self.stretch(s) for s in stretches])
        return b"".join([known.get(w) or word(w) for w in text.split(" ")])

    def decode(self, ids: Iterable[int]) -> str:
        surfaces = self.v.surfaces
        out = b"".join([surfaces[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _batches(texts: pa.Array, offsets: np.ndarray, encoder: Encoder):
    """Slices (first row, last row, ids, where each row's begin, decoded)."""
    for a, b in W.slices(offsets):
        found = [encoder.encode(t or "") for t in texts.slice(a, b - a).to_pylist()]
        begin = np.zeros(b - a + 1, dtype=np.int32)
        np.cumsum([len(f) // 4 for f in found], out=begin[1:])
        yield a, b, np.frombuffer(b"".join(found), dtype=np.int32), begin


def encoded(docs: DataFrame, text_col: str = "text", model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """The rows with the ids of their text (array of int)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def work(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            row = batch.column(0)
            texts = row.field(row.type.get_field_index(text_col))
            _, offsets = W.buffers(texts)
            for a, b, ids, begin in _batches(texts, offsets, encoder):
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin), pa.array(ids))], names=["_row", "ids"])

    rows = docs.select(whole(docs).alias("_row"))
    found = rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return found.select(*fields([c for c in docs.columns if c != ids_col]), F.col("ids").alias(ids_col))


def decoded(rows: DataFrame, ids_col: str = "ids", model: str = MODEL, text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; ids that are null have an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def work(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [encoder.decode(ids or ()) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["_row", "text"])

    packed = rows.select(F.col(ids_col).cast("array<int>").alias("_ids"), whole(rows).alias("_row"))
    found = packed.mapInArrow(work, T.StructType([packed.schema["_row"], T.StructField("text", T.StringType())]))
    return found.select(*fields([c for c in rows.columns if c != text_col]), F.col("text").alias(text_col))


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """_id, ids, n_ids and round_trip: whether decoding the ids gives the text back, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def work(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            _, offsets = W.buffers(batch.column(1))
            for a, b, ids, begin in _batches(batch.column(1), offsets, encoder):
                texts, flat = batch.column(1).slice(a, b - a).to_pylist(), ids.tolist()
                same = [encoder.decode(flat[x:y]) == (t or "").replace(SPACE, " ") for t, x, y in zip(texts, begin.tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin), pa.array(ids)), pa.array(same)], names=["_id", "ids", "round_trip"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>, round_trip boolean")
    return found.select("_id", "ids", F.size("ids").alias("n_ids"), "round_trip")
