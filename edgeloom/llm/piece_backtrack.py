"""SentencePiece encoding and decoding of merge-type models, by backtracking over longest matches.

A merge-type model joins, again and again, the adjacent pair whose joined piece has the highest score (the leftmost of equals).  A sequence of pieces
is the result of that exactly when each two neighbours are what their joined text is merged to by itself: a merge over a border would be the best of all
pairs, hence also the best inside those two.  So no queue of merges is run over a text.  An Aho-Corasick automaton gives the longest piece at each
position; it is taken if it fits the piece before it, else the next shorter prefix is tried; where none is left, the position
is marked as failed in a bitfield and the piece before is given up.  Fits are found by merging the two pieces anew and are remembered.
"""
from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from edgeloom.llm.common import chunks, column_of, id_text, texts_of

SPACE = "▁"
LETTERS = r"\p{L}\p{M}"
MAX_WORDS, MAX_FITS = 400_000, 600_000      # remembered a worker and generation; results do not depend on them
LONGEST_KEPT = 48                           # longer words are encoded each time
# fixed values of the model format: field numbers and piece types
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MERGE_TYPE = 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 0x7F) << shift, shift + 7, at + 1
        if b < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and types of a model file.  Models other than merge-type ones with byte pieces and no text rewriting raise ValueError."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == _PIECES:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, _NORMAL))
            elif field == _TRAINER:
                trainer = dict(_fields(value))
            elif field == _NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(3) != _MERGE_TYPE or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must be of merge type, keep the text as it is and escape spaces")
        if set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or self.kinds.count(_BYTE) != 256:
            raise ValueError("the model must have 256 byte pieces and no user-defined or unused pieces")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        order = {s: r for r, s in enumerate(sorted({s for s, k in zip(scores, self.kinds) if k == _NORMAL}, reverse=True))}
        self.rank = {p: order[s] for p, s, k in zip(self.pieces, scores, self.kinds) if k == _NORMAL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == _BYTE]
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()


class Codec:
    """Encoding and decoding of whole texts with one model."""

    def __init__(self, model: Model):
        self.model, self._rank = model, model.rank
        self.alphabet = {c for p in model.rank for c in p}
        whole = [p for p in model.rank if self._merged(p) == [p]]          # a piece that its own text does not merge to never comes out
        self.text = whole
        self.size = [len(p) for p in whole]
        self.packed = [struct.pack("<I", model.ids[p]) for p in whole]
        number = {p: n for n, p in enumerate(whole)}
        self.shorter = [next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number), -1) for p in whole]
        self.automaton = ahocorasick.Automaton()
        for n, p in enumerate(whole):
            self.automaton.add_word(p, n)
        self.automaton.make_automaton()
        # No merge reaches over two neighbouring characters that stand so in no piece.  Where that holds for each space mark after another
        # character, and for each other sign after a letter, the parts between are independent, and parts met before come from a cache.
        self._by_spaces = all(SPACE not in p.lstrip(SPACE) for p in model.rank)
        by_signs = self._by_spaces and not any(regex.search(f"[{LETTERS}][^{LETTERS}]", p) for p in model.rank)
        self._words = re.compile(f"{SPACE}*[^{SPACE}]*").findall
        self._parts = regex.compile(f"{SPACE}*[^{LETTERS}]*[{LETTERS}]*").findall if by_signs else None
        self._fits: dict[int, bool] = {}
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._surface = [p.replace(SPACE, " ") for p in model.pieces]
        self._special = [k != _NORMAL for k in model.kinds]
        self._byte = {i: b for b, i in enumerate(model.byte_ids)}
        self.edges = struct.pack("<I", model.begin), struct.pack("<I", model.end)

    def _merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text."""
        parts, rank = list(text), self._rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the joined text of two pieces is merged to these two again."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            a, b = self.text[left], self.text[right]
            known = self._merged(a + b) == [a, b]
            if len(self._fits) >= MAX_FITS:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Pieces of a text whose characters are all known; time in proportion to its length times the longest chain of prefixes."""
        n, size, shorter, fits, known = len(text), self.size, self.shorter, self.fits, self._fits.get
        longest = [0] * (n + 1)
        for end, piece in self.automaton.iter(text):      # ends rise, so the longest piece of each start comes last
            longest[end + 1 - size[piece]] = piece
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1:
                fit = not out or known(out[-1] << 32 | piece)
                if fit or fit is None and fits(out[-1], piece):
                    out.append(piece)
                    at, piece = end, longest[end]
                    continue
            while shorter[piece] < 0:                     # nothing fits here after the piece before
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= size[piece]
            piece = shorter[piece]
        return out

    def _word(self, word: str) -> bytes:
        """Packed ids of a word; characters that no piece holds become their bytes."""
        packed = self.packed
        if self.alphabet.issuperset(word):
            return b"".join([packed[p] for p in self._backtrack(word)])
        out, start = [], 0
        for i, c in enumerate(word):
            if c not in self.alphabet:
                out += [packed[p] for p in self._backtrack(word[start:i])]
                out += [struct.pack("<I", self.model.byte_ids[b]) for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        return b"".join(out + [packed[p] for p in self._backtrack(word[start:])])

    def _new_word(self, word: str) -> bytes:
        """A word that the young cache lacks; what was not asked for since the last change of caches is forgotten."""
        ids = self._old.get(word)
        if ids is None:
            parts = [p for p in self._parts(word) if p] if self._parts else [word]
            ids = self._word(word) if len(parts) == 1 else b"".join([self._young.get(p) or self._new_word(p) for p in parts])
        if len(word) <= LONGEST_KEPT:
            if len(self._young) >= MAX_WORDS:
                self._old, self._young = self._young, {}
            self._young[word] = ids
        return ids

    def encode_packed(self, text: str, edges: bool = True) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, with the begin and end ids if ``edges``."""
        out = [self.edges[0]] if edges else []
        if text:
            marked = self.model.prefix + text.replace(" ", SPACE)
            get, make = self._young.get, self._new_word
            for word in self._words(marked) if self._by_spaces else [marked]:
                ids = get(word)
                if ids is None:
                    ids = make(word)
                    get = self._young.get
                out.append(ids)
        if edges:
            out.append(self.edges[1])
        return b"".join(out)

    def encode(self, text: str, edges: bool = True) -> list[int]:
        return np.frombuffer(self.encode_packed(text, edges), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: control ids are silent, runs of byte ids are read as UTF-8 with U+FFFD for each ill-formed byte, and the
        space mark that encoding puts first is taken away.  Ids outside the vocabulary raise IndexError."""
        out: list[str] = []
        held = bytearray()
        first, taken = True, False
        surface, special = self._surface, self._special
        for i in ids:
            if not (first or held or special[i]):         # the common case, inside a text
                out.append(surface[i])
                continue
            b = self._byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            if taken or out:
                first = False
            kind, taken = self.model.kinds[i], False
            if kind == _UNKNOWN:
                out.append(self.model.unknown_surface)
            elif kind == _NORMAL:
                piece = surface[i]
                if first and self.model.prefix and piece.startswith(" "):
                    piece, taken = piece[1:], True
                if piece:
                    out.append(piece)
        if held:
            out.append(_characters(held))
        return "".join(out)


def _characters(data: bytearray) -> str:
    """UTF-8 text; each byte that begins no whole character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        b = data[at]
        size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
        try:
            out.append(data[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec of a model file; the path must exist on every worker."""
    if path not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[path] = Codec(Model(file.read()))
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *, edges: bool = True) -> DataFrame:
    """``doc_id, ids`` of every row, whole texts; null and empty texts have the begin and end ids only, repeated rows repeat; no shuffle."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches):
            ids = pa.array([own.encode(t, edges) for t in texts_of(part)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), ids], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are none."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = pa.array([own.decode(i or []) for i in column_of(batch, "ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded with begin and end ids, then decoded from the ids.

    Null texts are empty; rows with equal or null ids are rows each; an empty table gives no rows; other columns are left behind.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches):
            counts, first, second = [], [], []
            for t in texts_of(part):
                packed = own.encode_packed(t)
                counts.append(len(packed) // 4)
                first.append(hashlib.sha256(packed).hexdigest())
                second.append(hashlib.sha256(own.decode(np.frombuffer(packed, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()),
                                              pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
