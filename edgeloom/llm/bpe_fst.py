"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding by an incremental UTF-8 machine.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours are: merging the bytes of the pair
gives the pair again.  So the transducer's hypotheses are "tokens so far, place in the vocabulary trie"; a token may be
finished only if it may follow the one before it.  Reading a byte moves all hypotheses; a set of them is one state, made when first met,
and a transition emits the tokens on which all its hypotheses agree.  A hypothesis dies with its trie branch, so the lookahead is at most
the longest token.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from edgeloom.llm.common import chunks, column_of, id_text, texts_of

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_STATES, MAX_PAIRS, MAX_PIECES = 60_000, 600_000, 200_000        # sizes of tables and caches; results do not depend on them


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """``encode_piece`` of one pre-split piece; states are built as texts need them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.next: dict[int, int] = {}          # trie: node * 256 + byte -> node
        self.token: list[int] = [-1]            # node -> token that ends there
        self.inner: list[bool] = [False]        # node -> has children
        for word, rank in ranks.items():
            node = 0
            for b in word:
                key = node << 8 | b
                at = self.next.get(key)
                if at is None:
                    at = self.next[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = at
            self.token[node] = rank
        self._made_of: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, list[tuple[bytes, int]]] = {}
        self._follows: dict[int, bool] = {}
        self._id = {(-1, (((), 0),)): 0}
        self._states = [(-1, (((), 0),))]
        self._step: dict[int, tuple[int, tuple]] = {}

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose union gave the token, by the definition (always the lowest rank first); None for a byte, and for a
        token that merging its own bytes does not give."""
        if token in self._made_of:
            return self._made_of[token]
        word, rank = self.bytes_of[token], self.ranks.get
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank(parts[i] + parts[i + 1], 1 << 40))
            if rank(parts[best] + parts[best + 1]) is None:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        made = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self._made_of[token] = made
        return made

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at the token's right (1) or left (0) edge while it is merged, each with the rank that absorbs it."""
        key = token << 1 | side
        out = self._edges.get(key)
        if out is None:
            out, at, until = [], token, 1 << 40
            while True:
                out.append((self.bytes_of[at], until))
                made = self._last_merge(at)
                if made is None:
                    break
                at, until = made[side], at
            self._edges[key] = out
        return out

    def _may_follow(self, before: int, token: int) -> bool:
        """Neither is a token that merging cannot reach, and at no time would a part of one merge with a part of the other."""
        key = before << 20 | token
        ok = self._follows.get(key)
        if ok is None:
            ok = len(self.bytes_of[token]) == 1 or self._last_merge(token) is not None
            if ok and before >= 0:
                rank = self.ranks.get
                for left, left_until in self._edge(before, 1):
                    for right, right_until in self._edge(token, 0):
                        joined = rank(left + right)
                        # equal ranks merge from the left, so the part on the left is absorbed first
                        if joined is not None and joined < left_until and joined <= right_until:
                            ok = False
            if len(self._follows) > MAX_PAIRS:
                self._follows.clear()
            self._follows[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        last, hypotheses = self._states[state]
        made, step, tokens, inner = [], self.next.get, self.token, self.inner
        for held, node in hypotheses:
            at = step(node << 8 | byte)
            if at is not None:
                token = tokens[at]
                if token >= 0 and self._may_follow(held[-1] if held else last, token):
                    made.append((held + (token,), 0))
                if inner[at]:
                    made.append((held, at))
        out: tuple = ()
        if len(made) == 1:
            out, made = made[0][0], [((), made[0][1])]
        else:
            while made[0][0]:
                head = made[0][0][0]
                for held, _ in made:
                    if not held or held[0] != head:
                        break
                else:
                    out += (head,)
                    made = [(held[1:], node) for held, node in made]
                    continue
                break
        # hypotheses keep the order of their beginnings, so equal sets are equal tuples
        new = (out[-1] if out else last, tuple(made))
        at = self._id.get(new)
        if at is None:
            at = self._id[new] = len(self._states)
            self._states.append(new)
        moved = self._step[state << 8 | byte] = at, out
        return moved

    def transduce(self, word: bytes) -> list[int]:
        """Token ids of a piece, by running the transducer over all its bytes."""
        out: list[int] = []
        state, step = 0, self._step
        for i, b in enumerate(word):
            moved = step.get(state << 8 | b)
            if moved is None:
                if len(self._states) >= MAX_STATES:
                    return out + self._undetermined(state, word[i:])
                moved = self._move(state, b)
            state, emitted = moved
            if emitted:
                out += emitted
        if word:
            out += next(held for held, node in self._states[state][1] if node == 0)
        return out

    def _undetermined(self, state: int, word: bytes) -> list[int]:
        """The rest of a piece once the table of states is full: hypotheses move one by one and are not kept as a state."""
        last, hypotheses = self._states[state]
        root = (None, last)
        alive = []
        for held, node in hypotheses:
            chain = root
            for token in held:
                chain = (chain, token)
            alive.append((chain, node))
        step, tokens, inner, follows = self.next.get, self.token, self.inner, self._follows
        for b in word:
            moved, ended = [], False                   # one token at most ends validly at a byte
            for chain, node in alive:
                at = step(node << 8 | b)
                if at is not None:
                    token = tokens[at]
                    if token >= 0 and not ended:
                        ended = follows.get(chain[1] << 20 | token)
                        if ended is None:
                            ended = self._may_follow(chain[1], token)
                        if ended:
                            moved.append(((chain, token), 0))
                    if inner[at]:
                        moved.append((chain, at))
            alive = moved
        chain = next(c for c, node in alive if node == 0)
        out = []
        while chain is not root:
            chain, token = chain
            out.append(token)
        return out[::-1]

    def encode_piece(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        return [whole] if whole is not None else self.transduce(word)


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters complete so far, ``close`` what is left.

    A state is the bytes of a started character with the range its next byte must be in.  Each ill-formed part becomes one U+FFFD.
    """

    def __init__(self) -> None:
        self.value = self.missing = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.value, self.missing = self.value << 6 | b & 0x3F, self.missing - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                self.missing = 0
                out.append("�")
            self.low, self.high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.value, self.missing = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.value, self.missing = b & 0x0F, 2
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.value, self.missing = b & 0x07, 3
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.missing = "�" * bool(self.missing), 0
        return left


class Codec:
    """Encoding and decoding of whole texts; pieces seen before come from a cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.machine, self.split = Transducer(ranks), regex.compile(pattern)
        self.whole: dict[int, str | None] = {}
        for i, b in self.machine.bytes_of.items():
            try:
                self.whole[i] = b.decode()
            except UnicodeDecodeError:
                self.whole[i] = None            # a part of a character
        self.decimal = {i: str(i).encode() for i in self.whole}
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """A piece that the young cache lacks; what was not asked for since the last change of caches is forgotten."""
        ids = self._old.get(piece)
        if ids is None:
            ids = tuple(self.machine.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) < 64:
            if len(self._young) >= MAX_PIECES:
                self._old, self._young = self._young, {}
            self._young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, make = self._young.get, self._piece
        out: list[int] = []
        for piece in self.split.findall(text):
            ids = get(piece)
            if ids is None:
                ids = make(piece)
                get = self._young.get
            out += ids
        return out

    def encode_with_digest(self, text: str) -> tuple[list[int], str]:
        """Ids, and the SHA-256 of the decimal ids joined by commas."""
        ids = self.encode(text)
        return ids, hashlib.sha256(b",".join([self.decimal[i] for i in ids])).hexdigest()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, ill-formed bytes as U+FFFD; ids outside the vocabulary raise KeyError."""
        parts = [self.whole[i] for i in ids]
        if None not in parts:
            return "".join(parts)
        stream = Utf8Stream()
        for n, (i, part) in enumerate(zip(ids, parts)):
            if part is None or stream.missing:
                parts[n] = stream.feed(self.machine.bytes_of[i])
        return "".join(parts) + stream.close()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec of a rank file; the path must exist on every worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(read_ranks(path))
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row, whole texts, no special tokens; null and empty texts have no ids, repeated rows repeat; no shuffle."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array([own.encode(t) for t in texts_of(part)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are none."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = column_of(batch, "ids").to_pylist()
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([own.decode(i or []) for i in ids], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from the ids."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in chunks(batches):
            counts, first, second = [], [], []
            for t in texts_of(part):
                ids, digest = own.encode_with_digest(t)
                counts.append(len(ids))
                first.append(digest)
                second.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()),
                                              pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
