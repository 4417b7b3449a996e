"""Operator 6, byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

A merge list has a sufficient lookahead: how many symbols to the right of a
token can still change it.  It is computed from the merges, so a piece of any
length is encoded through a window of constant size; tokens that end at least
the lookahead before the window's end are stable and leave, the rest stays.
A text is cut into segments before white space, where no piece, merge or
normalisation reaches across, and its ids leave segment by segment.  Decoding
feeds each id's bytes to an incremental state machine.  So beside the text itself memory is
constant (a segment without white space is as long as it is).

The vocabulary comes from a tokenizer file (JSON) whose path is a parameter;
supported are the two kinds of byte-level files described in its package:
lower-cased words with an end-of-word mark, and plain byte-level pieces.

Defined results: null and empty texts have no ids and decode to empty text;
repeated rows are each encoded; strings of special tokens inside a text become
their ids, as in the tokenizers library.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

WORD_BPE = "word_bpe_49k.json"
#: Encoded pieces a worker remembers; when full it starts anew, so memory stays constant.
REMEMBERED = 300_000
#: Characters of a text that are cut into pieces at once, about.
SEGMENT_CHARS = 1 << 18
#: Longer pieces are never remembered.
PIECE_BYTES = 64
#: White_Space of Unicode, fixed.
_SPACE = "\t-\r \x85\xa0  -     　"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary package keeps a file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int]], spelled: dict[int, str], ended: set[int]) -> int:
    """Symbols to the right of a token that can still decide over it.

    A merge (u, v) is undone only by an earlier merge (x, y) whose x ends where
    v ends, which needs y and, in turn, what decides over y.  Merges are taken
    in order, ``reach[x]`` holding the most that the merges so far with left part
    x need.  The first y of a merge is bounded by the longest token.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in merges:
        token = spelled[left] + spelled[right]
        need = 0
        if right not in ended:
            need = max((reach.get(token[k:], 0) for k in range(len(token))), default=0)
        most = max(most, need)
        own = len(spelled[right]) + need
        if own > reach.get(spelled[left], 0):
            reach[spelled[left]] = own
    return most + max(map(len, spelled.values()))


class ByteBpe:
    """Merges, vocabulary and text rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        self.folds = "Lowercase" in kinds
        letters, numbers, other = r"\p{L}", r"\p{N}", rf"[^{_SPACE}\p{{L}}\p{{N}}]+"
        if self.folds:
            pattern = f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|{other}"
        else:
            pattern = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?{other}|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        self._pieces = regex.compile(pattern).findall
        self._cut = regex.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
        alphabet = byte_alphabet()
        self.first = [vocab.get(c, -1) for c in alphabet]
        self.last = [vocab.get(c + suffix, -1) for c in alphabet] if suffix else self.first
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        ended = {i for t, i in vocab.items() if suffix and t.endswith(suffix)}
        spelled = {i: t[: -len(suffix)] if i in ended else t for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead([(vocab[a], vocab[b]) for a, b in pairs], spelled, ended)
        self.window = max(512, 4 * self.lookahead)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spaced = spec["decoder"] is None  # without a decoder the library joins tokens by spaces
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = t.encode() if self.spaced else bytes(back[c] for c in t)
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self._lengths = {i: len(t) for i, t in spelled.items()}
        self._known = _Remembered(self._encode_piece)

    # -- encoding ------------------------------------------------------------------------

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost of equals, until none is left."""
        merges, none = self.merges, 1 << 60
        ranks = [merges.get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best & 0xFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = merges.get(ids[at - 1] << 20 | ids[at], none)
            if at < len(ranks):
                ranks[at] = merges.get(ids[at] << 20 | ids[at + 1], none)
        return ids

    def stream(self, piece: bytes):
        """Ids of one piece, emitted once stable; holds one window of symbols at most."""
        at, end, window = 0, len(piece), self.window
        while end - at > window:
            ids = self._merge([self.first[b] for b in piece[at : at + window]])
            stop, done = at + window - self.lookahead, at
            for i in ids:
                if done + self._lengths[i] > stop:
                    break
                done += self._lengths[i]
                yield i
            at = done
        ids = [self.first[b] for b in piece[at:end]]
        if ids:
            ids[-1] = self.last[piece[end - 1]]
            yield from self._merge(ids)

    def _encode_piece(self, piece: str) -> bytes:
        return array("I", [i for i in self.stream(piece.encode()) if i >= 0]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_chunks(text))

    def encode_chunks(self, text: str | None):
        """The same, segment by segment."""
        at = 0
        for m in self._special.finditer(text or "") if self._special else ():
            yield from self._plain(text, at, m.start())
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text or "", at, len(text or ""))

    def _plain(self, text: str, at: int, end: int):
        """Ids of a part without special tokens."""
        while at < end:
            cut = self._cut.search(text, at + SEGMENT_CHARS, end) if end - at > SEGMENT_CHARS else None
            stop = cut.start() if cut else end
            part = text[at:stop]
            if self.folds:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            yield b"".join(map(self._known.__getitem__, self._pieces(part)))
            at = stop

    # -- decoding ------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        machine = Decoder(self)
        step = 1 << 18
        return "".join([machine.feed(ids[at : at + step]) for at in range(0, len(ids), step)]) + machine.end()


class Decoder:
    """Byte-to-text state machine: ids come in chunks, bytes of an unfinished character wait."""

    def __init__(self, tokenizer: ByteBpe):
        self._own, self._begun = tokenizer, False
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        """Text that is complete with these ids."""
        tokens = map(self._own.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        if not self._own.spaced:
            return self._state.decode(b"".join(tokens))
        if not ids:
            return ""
        between, self._begun = b" " * self._begun, True
        return self._state.decode(between + b" ".join(tokens))

    def end(self) -> str:
        return self._state.decode(b"", True)


class _Remembered(dict):
    """Pieces encoded before; emptied when it holds REMEMBERED."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self._encode(piece)
        if len(piece) <= PIECE_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def load(name: str) -> ByteBpe:
    """A tokenizer of the vocabulary package, or of a path; once per worker."""
    return ByteBpe(name if "/" in name else tokenizer_path(name))


# -- columns ------------------------------------------------------------------------------------


def encode(text: Column, tokenizer: str = WORD_BPE) -> Column:
    """Ids as binary (little-endian unsigned 32-bit)."""

    @F.arrow_udf(BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        own = load(tokenizer)
        return pa.array([own.encode(t) for t in texts.to_pylist()], pa.binary())

    return run(text)


def decode(ids: Column, tokenizer: str = WORD_BPE) -> Column:
    """Text of binary ids."""

    @F.arrow_udf(StringType())
    def run(rows: pa.Array) -> pa.Array:
        own = load(tokenizer)
        return pa.array([own.decode(r or b"") for r in rows.to_pylist()], pa.string())

    return run(ids)


_DIGEST = StructType([StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def round_trip(text: Column, tokenizer: str = WORD_BPE, keep_ids: bool = True) -> Column:
    """(ids, n_tokens, ids_sha256, decoded_sha256): a text encoded, its ids decoded, both hashed as they come.

    Without ``keep_ids`` the ids stay null: only the digests leave the worker.
    """

    @F.arrow_udf(_DIGEST)
    def run(texts: pa.Array) -> pa.Array:
        own = load(tokenizer)
        kept, n, a, b = [], [], [], []
        for t in texts:
            machine, many, own_ids, encoded, decoded = Decoder(own), 0, [], hashlib.sha256(), hashlib.sha256()
            for chunk in own.encode_chunks(t.as_py()):
                many += len(chunk) // 4
                encoded.update(chunk)
                decoded.update(machine.feed(chunk).encode())
                if keep_ids:
                    own_ids.append(chunk)
            decoded.update(machine.end().encode())
            kept.append(b"".join(own_ids) if keep_ids else None)
            n.append(many)
            a.append(encoded.hexdigest())
            b.append(decoded.hexdigest())
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def with_ids(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """``docs`` with the column ``ids``."""
    return docs.withColumn("ids", encode(F.col("text"), tokenizer))
