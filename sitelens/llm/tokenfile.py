"""Operator 9, token-id files: adaptive context-mixing range coder in independent blocks.

Ids are cut into blocks of BLOCK ids.  Each block carries its length, a CRC-32 of
its ids, its distinct ids with their counts, and its ids as places among these,
so any block decodes alone and a damaged one is found.

The model mixes three distributions over the distinct ids: order 0, by the counts
that were left of each at the last place of RENEWED; order 1, the last two that followed the id
before; order 2, the last that followed the two ids before (by a hash of
both).  The weights belong to a state, what orders 1 and 2 have seen in their context,
how often they were right in a row and whether they agree, and are the shares of
its visits that each foretold.  An id takes one range-coding step, by its interval in
the mixture.  Interval ends are sums of a few terms and order 0 is a table by
place, so neither coding nor decoding searches.  All arithmetic is on integers
and on single operations of IEEE doubles, so files decode alike everywhere.

The library encodes each distinct piece of text once (``_Pieces``).

Blocks are coded in lockstep, one numpy lane each.  ``write`` deals documents to
files by ranges of doc_id, as many as the text asks for.  A file is rows of
segments: whole documents of some SEGMENT ids, their index and their blocks.
Segments are written and read one after the other and decode alone, so a task
holds a few of them, and reading shuffles nothing.

Defined results: null texts are empty and give just the end id; repeated rows
are each written, in the order of their texts; null doc_ids come first; an id of 2**18 - 4 or
more is an error; no rows give no file; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import partitions_for, write_table

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0
BLOCK = 1024
#: Blocks coded in lockstep; bounds the memory of a task.
LANES = 2048
#: Ids of a segment, if documents allow.
SEGMENT = 1 << 18
#: Characters of text in a file, about.
FILE_CHARS = 64 << 20
#: Characters given to the tokenizer at once.
ENCODE_CHARS = 1 << 19
#: Pieces of text whose ids a task remembers.
PIECES = 1 << 18
#: The first characters of a text that choose its file among documents of one doc_id.
PREFIX = 64
MAGIC = b"C3"
MAX_ID = (1 << 18) - 5
_HEADER = struct.Struct("<2sHIH")  # magic, ids, CRC-32 of the ids, payload words

_U = np.uint64
_WORD = _U(1 << 32)
_PLACE_BITS = 10
_CONTEXTS2 = 2048
_KINDS = 54
_REFRESH = 16
_STATES = 32
_PRIOR = 128
_TOTAL_BITS = 24
_TOTAL = 1 << _TOTAL_BITS
#: Places of a block at which order 0 becomes what is left of it.
_RENEWED = (256, 512, 640, 768, 832, 896, 928, 960, 992)
#: Shares of 2**12 of the number of bits of a count beyond 2.
_SIZES = np.cumsum([0, 704, 832, 960, 960, 416, 128, 48, 24, 16, 8], dtype=np.int64)


class _Encoder:
    """64-bit range coders, one per lane, that emit 32-bit words and carry into what they emitted."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.out = np.zeros((lanes, words), np.uint32)
        self.size = np.zeros(lanes, np.int64)

    def order(self, lanes: np.ndarray) -> None:
        self.low, self.range, self.out, self.size = self.low[lanes], self.range[lanes], self.out[lanes], self.size[lanes]

    def step(self, lanes: slice | np.ndarray, bits: int | np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Narrow to ``width`` at ``start`` of 2 ** bits."""
        unit, low = self.range[lanes] >> np.asarray(bits, _U), self.low[lanes]
        moved = low + unit * start.astype(_U)
        over = np.flatnonzero(moved < low)
        if len(over):
            self._carry(over if isinstance(lanes, slice) else lanes[over])
        spread = unit * width.astype(_U)
        small = np.flatnonzero(spread < _WORD)
        if len(small):
            at, held = small if isinstance(lanes, slice) else lanes[small], moved[small]
            size = self.size[at]
            self.out[at, size] = held >> _U(32)
            self.size[at] = size + 1
            moved[small] = held << _U(32)
            spread[small] <<= _U(32)
        self.low[lanes], self.range[lanes] = moved, spread

    def _carry(self, lanes):
        at = self.size[lanes] - 1
        while len(lanes):
            self.out[lanes, at] += np.uint32(1)
            on = self.out[lanes, at] == 0
            lanes, at = lanes[on], at[on] - 1

    def payloads(self) -> list[bytes]:
        """One word more decides: the range is never less than a word, so some multiple of one lies in it."""
        lanes = np.arange(len(self.low))
        last = self.low + (_WORD - _U(1))
        over = np.flatnonzero(last < self.low)
        if len(over):
            self._carry(over)
        self.out[lanes, self.size] = last >> _U(32)
        return [self.out[k, : n + 1].astype("<u4").tobytes() for k, n in enumerate(self.size.tolist())]


class _Decoder:
    """The same in reverse: holds how far the coded number lies above the low end."""

    def __init__(self, payloads: list[bytes]):
        lanes = len(payloads)
        self.words = np.zeros((lanes, max(map(len, payloads)) // 4 + 4), np.uint32)
        for k, p in enumerate(payloads):
            self.words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.above = self.words[:, 0].astype(_U) << _U(32) | self.words[:, 1]
        self.at = np.full(lanes, 2, np.int64)

    def order(self, lanes: np.ndarray) -> None:
        self.words, self.range, self.above, self.at = self.words[lanes], self.range[lanes], self.above[lanes], self.at[lanes]

    def place(self, lanes: slice | np.ndarray, bits: int | np.ndarray) -> np.ndarray:
        """Which of 2 ** bits the coded number lies in."""
        bits = np.asarray(bits, _U)
        return np.minimum(self.above[lanes] // (self.range[lanes] >> bits), (_U(1) << bits) - _U(1)).astype(np.int64)

    def step(self, lanes, bits, start, width):
        unit = self.range[lanes] >> np.asarray(bits, _U)
        above, spread = self.above[lanes] - unit * start.astype(_U), unit * width.astype(_U)
        small = np.flatnonzero(spread < _WORD)
        if len(small):
            at = small if isinstance(lanes, slice) else lanes[small]
            place = self.at[at]
            above[small] = above[small] << _U(32) | self.words[at, np.minimum(place, self.words.shape[1] - 1)]
            self.at[at] = place + 1
            spread[small] <<= _U(32)
        self.above[lanes], self.range[lanes] = above, spread


def _first_counts() -> np.ndarray:
    """Counters of a state at first: hits of order 2 and of order 1 alone, and all; a state is what either has seen and whether they agree."""
    out = np.zeros(_STATES, np.int64)
    for state in range(_STATES):
        alike, two, one = state >> 4, state >> 2 & 3, state & 3
        h2 = ((0, 0.05, 0.6, 0.95), (0, 0.15, 0.7, 0.95))[alike][two]
        h1 = (0, (0.05, 0.1)[alike], 0.2, 0.7 - 0.5 * alike)[one] * (1 - h2)
        out[state] = _PRIOR << 32 | int(h1 * _PRIOR) << 16 | int(h2 * _PRIOR)
    return out


def _counted(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: number of distinct ids, these in order, how often each comes, and each place's number among them."""
    lanes, steps = ids.shape
    key = (ids.astype(np.int32) << _PLACE_BITS) | np.arange(steps, dtype=np.int32)
    inside = np.arange(steps) < lengths[:, None]
    key[~inside] = 2**31 - 1  # what is beyond a row's end goes last
    key.sort(axis=1)
    ranked = key >> _PLACE_BITS
    new = np.ones(ids.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    new &= inside
    rank = np.cumsum(new, axis=1, dtype=np.int32) - 1
    many = rank[:, -1] + 1
    slots = np.zeros((lanes, steps), np.int32)
    at = np.where(inside, key & ((1 << _PLACE_BITS) - 1), np.arange(steps))
    np.put_along_axis(slots, at, rank, 1)
    lane, first = np.nonzero(new)
    distinct, counts = np.zeros((lanes, int(many.max())), np.int64), np.zeros((lanes, int(many.max())), np.int64)
    to = rank[lane, first]
    distinct[lane, to] = ranked[lane, first]
    ends = np.append(first[1:], 0)
    last = to == many[lane] - 1
    counts[lane, to] = np.where(last, lengths[lane], ends) - first
    return many, distinct, counts, slots


def _set_of(coder, many: np.ndarray, distinct: np.ndarray, counts: np.ndarray, known: bool) -> None:
    """The distinct ids of each lane (the most of them first) and their counts, in order: gaps by class and bits left, with the count up to 3."""
    lanes, width = distinct.shape
    freq, bounds = np.repeat(np.where(np.arange(_KINDS) < 36, 16, 1), lanes).reshape(_KINDS, lanes), np.zeros((_KINDS + 1, lanes), np.int64)
    before = np.full(lanes, -1, np.int64)
    at = np.arange(lanes)
    for j in range(width):
        m = int(np.searchsorted(-many, -j, side="left"))  # lanes with more than j
        on, lane = slice(0, m), at[:m]
        if j % _REFRESH == 0:
            summed = np.cumsum(freq, axis=0)
            bounds[1:] = summed * (4096 - _KINDS) // summed[-1] + np.arange(1, _KINDS + 1)[:, None]
            freq -= freq >> 1
        if known:
            gap = distinct[:m, j] - before[:m]
            cls = np.frexp(gap.astype(np.float64))[1] - 1
            low = gap - (1 << cls)
            kind = cls * 3 + np.minimum(counts[:m, j], 3) - 1
        else:
            place = coder.place(on, 29)
            kind = np.count_nonzero(bounds[1:-1, :m] <= place >> 17, axis=0)
            cls = kind // 3
        left, wide = bounds[kind, lane], bounds[kind + 1, lane] - bounds[kind, lane] << (17 - cls)
        if not known:
            low = np.minimum((place - (left << 17)) // wide, (1 << cls) - 1)
            distinct[:m, j] = before[:m] + (1 << cls) + low
            counts[:m, j] = kind % 3 + 1
        coder.step(on, 29, (left << 17) + low * wide, wide)
        freq[kind, lane] += 12
        before[:m] = distinct[:m, j]
        often = np.flatnonzero(kind % 3 == 2)
        if len(often):
            if known:
                more = counts[often, j] - 2
                size = np.frexp(more.astype(np.float64))[1] - 1
            else:
                size = np.searchsorted(_SIZES, coder.place(often, 12), side="right") - 1
            coder.step(often, 12, _SIZES[size], _SIZES[size + 1] - _SIZES[size])
            low = more - (1 << size) if known else coder.place(often, size)
            coder.step(often, size, low, np.ones(len(often), np.int64))
            counts[often, j] = low + (1 << size) + 2


def _sequence(coder, lengths: np.ndarray, counts: np.ndarray, slots: np.ndarray, known: bool) -> None:
    """The slots of each lane (the longest first) by the mixture, a row a step; with ``known`` it codes them, else it fills them in."""
    steps, lanes = slots.shape
    width = counts.shape[1]
    row = width + 2
    lane = np.arange(lanes, dtype=np.int32)
    base, base1, base2, base_s = lane * row, lane * (width + 1), lane * _CONTEXTS2, lane * _STATES
    ring1 = np.full(lanes * (width + 1), width << 13 | width << 2, np.int32)  # the last two
    ring2 = np.full(lanes * _CONTEXTS2, width << 2, np.int16)
    seen = np.tile(_first_counts(), lanes)
    a, b = np.zeros(lanes, np.int32), np.full(lanes, width, np.int32)  # no slot is before the first
    left, since = counts, 0
    for t in range(steps):
        if t == 0 or t in _RENEWED:
            if t:
                m = int(np.searchsorted(-lengths, -since, side="left"))
                some = slots[since:t, :m] + lane[:m] * width
                some = some[np.arange(since, t)[:, None] < lengths[:m]]
                left = (left - np.bincount(some.ravel(), minlength=lanes * width).reshape(lanes, width)).astype(np.int32)
                if left.min() < 0:
                    raise ValueError("damaged block: an id comes too often")
                since = t
            below = np.zeros((lanes, row), np.int32)
            np.cumsum(left, axis=1, dtype=np.int32, out=below[:, 1:-1])
            rest = below[:, -2].copy()
            below[:, -1] = rest
            below = below.ravel()
            if not known:
                table = np.repeat(np.tile(np.arange(width, dtype=np.int16), lanes), left.ravel())
                first = np.cumsum(rest, dtype=np.int32) - rest
        m = int(np.searchsorted(-lengths, -t, side="left"))  # lanes with more than t
        on = slice(0, m)
        a, b = a[:m], b[:m]
        at1 = base1[:m] + b
        at2 = base2[:m] + ((a * 40503 + (b * 25717 if t else 0) >> 3) & (_CONTEXTS2 - 1))
        v1, v2 = ring1.take(at1), ring2.take(at2).astype(np.int32)
        last, c2 = v1 >> 2 & 2047, v2 >> 2
        alike = last == c2
        c1 = np.where(alike, v1 >> 13, last)
        sure1, sure2 = v1 & 3, v2 & 3
        state = base_s[:m] + (np.int32(16) * alike + sure2 * 4 + sure1 * (c1 != width))
        k = seen.take(state)
        unit = _TOTAL / (k >> 32)
        w2, w1 = (unit * (k & 0xFFFF)).astype(np.int32), (unit * (k >> 16 & 0xFFFF)).astype(np.int32)
        w0 = ((_TOTAL - w1 - w2) / rest[:m]).astype(np.int32)  # exact: a quotient of whole numbers below 2**25
        if known:
            s = slots[t, :m]
        else:
            place = coder.place(on, _TOTAL_BITS).astype(np.int32)
            swap = c1 < c2
            low, high = np.where(swap, c1, c2), np.where(swap, c2, c1)
            w_low = np.where(swap, w1, w2)
            at_low, at_high = base[:m] + low, base[:m] + high
            end_low = w0 * below.take(at_low + 1) + w_low
            start_high = w0 * below.take(at_high) + w_low
            end_high = w0 * below.take(at_high + 1) + w1 + w2
            past_low, past_high = place >= end_low, place >= end_high
            index = ((place - w_low * past_low - (w1 + w2 - w_low) * past_high) / w0).astype(np.int32)
            s = table.take(first[:m] + np.minimum(index, rest[:m] - 1)).astype(np.int32)
            s = np.where(~past_low & (place >= w0 * below.take(at_low)), low, s)
            s = np.where(past_low & ~past_high & (place >= start_high), high, s)
            slots[t, :m] = s
        at = base[:m] + s
        before = below.take(at)
        hit1, hit2 = s == c1, s == c2
        coder.step(on, _TOTAL_BITS, w0 * before + w1 * (c1 < s) + w2 * (c2 < s), w0 * (below.take(at + 1) - before) + w1 * hit1 + w2 * hit2)
        seen[state] = k + ((16 << 32) + hit2 * 16 + hit1 * (16 << 16))
        again = s == last
        ring1[at1] = np.where(again, v1 & -4, last << 13 | s << 2) + (np.minimum(sure1, 2) * again + 1)
        ring2[at2] = s * 4 + (np.minimum(sure2, 2) * hit2 + 1)
        a, b = b if t else a, s


def _groups(blocks: int) -> list[tuple[int, int]]:
    """Ends of groups of at most LANES, alike in size: a small one takes nearly as long."""
    many = -(-blocks // LANES)
    cuts = [blocks * k // many for k in range(many + 1)] if many else []
    return list(zip(cuts, cuts[1:], strict=False))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Ids as coded blocks with headers."""
    return [b for part in encode_segments([ids], block) for b in part]


def encode_segments(segments: list[np.ndarray], block: int = BLOCK) -> list[list[bytes]]:
    """The coded blocks of each segment; blocks of several are coded side by side."""
    if not 1 <= block <= BLOCK:
        raise ValueError(f"a block has 1 to {BLOCK} ids")
    cuts = [(k, s[i : i + block]) for k, s in enumerate(segments) for i in range(0, len(s), block)]
    out: list[list[bytes]] = [[] for _ in segments]
    for at, end in _groups(len(cuts)):
        group = cuts[at:end]
        lengths = np.array([len(c) for _, c in group], np.int64)
        table = np.zeros((len(group), int(lengths.max())), np.int64)
        for row, (_, c) in zip(table, group, strict=True):
            row[: len(c)] = c
        if table.max() > MAX_ID or table.min() < 0:
            raise ValueError(f"ids must lie in 0 to {MAX_ID}")
        payloads = _coded(table, lengths)
        for (k, c), payload in zip(group, payloads, strict=True):
            out[k].append(_HEADER.pack(MAGIC, len(c), zlib.crc32(c.astype("<u4").tobytes()), len(payload) // 4) + payload)
    return out


def _coded(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The payload of each row."""
    many, distinct, counts, slots = _counted(ids, lengths)
    order = np.argsort(-many, kind="stable")
    coder = _Encoder(len(ids), ids.shape[1] * 80 // 32 + 8)
    coder.step(slice(None), _PLACE_BITS, many[order] - 1, np.ones(len(ids), np.int64))
    _set_of(coder, many[order], distinct[order], counts[order], True)
    then = np.argsort(-lengths[order], kind="stable")
    order = order[then]
    coder.order(then)
    _sequence(coder, lengths[order], counts[order], np.ascontiguousarray(slots[order].T), True)
    out = coder.payloads()
    return [out[k] for k in np.argsort(order).tolist()]


def _decoded(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Rows of ids of the payloads."""
    lanes, steps = len(payloads), int(lengths.max())
    coder = _Decoder(payloads)
    many = coder.place(slice(None), _PLACE_BITS)
    coder.step(slice(None), _PLACE_BITS, many, np.ones(lanes, np.int64))
    many += 1
    order = np.argsort(-many, kind="stable")
    coder.order(order)
    distinct, counts = np.zeros((2, lanes, int(many.max())), np.int64)
    _set_of(coder, many[order], distinct, counts, False)
    if distinct.max() > MAX_ID or (counts.sum(axis=1) != lengths[order]).any():
        raise ValueError("damaged block: its ids are too large, too few or too many")
    then = np.argsort(-lengths[order], kind="stable")
    order = order[then]
    coder.order(then)
    slots = np.zeros((steps, lanes), np.int32)
    _sequence(coder, lengths[order], counts[then], slots, False)
    out = np.empty((lanes, steps), np.int64)
    out[order] = np.take_along_axis(distinct[then], slots.T, 1)
    return out


def split_blocks(data: bytes) -> list[bytes]:
    """Blocks that lie one after the other."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise ValueError("not a block, or cut short")
        end = at + _HEADER.size + 4 * _HEADER.unpack_from(data, at)[3]
        out.append(data[at:end])
        at = end
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks; ValueError for a block that is damaged."""
    found = []
    for at, end in _groups(len(blocks)):
        group = blocks[at:end]
        if any(len(b) < _HEADER.size for b in group):
            raise ValueError("not a block, or cut short")
        heads = [_HEADER.unpack_from(b) for b in group]
        payloads = [b[_HEADER.size :] for b in group]
        for (magic, _, _, size), p in zip(heads, payloads, strict=True):
            if magic != MAGIC or 4 * size != len(p):
                raise ValueError("not a block, or cut short")
        lengths = np.array([h[1] for h in heads], np.int64)
        if lengths.min() < 1 or lengths.max() > BLOCK:
            raise ValueError(f"a block has 1 to {BLOCK} ids")
        table = _decoded(payloads, lengths)
        for k, (_, n, crc, _) in enumerate(heads):
            raw = table[k, :n].astype("<u4")
            if zlib.crc32(raw.tobytes()) != crc:
                raise ValueError(f"checksum of block {at + k} does not match")
            found.append(raw)
    return np.concatenate(found) if found else np.zeros(0, "<u4")


# -- files ---------------------------------------------------------------------------------------

#: ``at``: ids of the file before the segment; ``ids``: ids in it.
_SEGMENTS = "file int, segment int, at long, ids long, doc_ids binary, blocks binary"


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # of ASCII, but for the apostrophe
_PIECE = re.compile(
    rf" ?[{_LETTERS}]++(?=[\n -@\[-`{{-~]|\Z)| ?[{_MARKS}]++(?=[\n 0-9{_LETTERS}]|\Z)| ?[0-9]++(?=[\n '{_MARKS}{_LETTERS}]|\Z)"
    rf"|\n(?=['{_MARKS}0-9{_LETTERS}])|.+?(?:(?<=['{_MARKS}0-9{_LETTERS}])(?= )|\Z)",
    re.DOTALL,
)


@lru_cache(maxsize=1)
def _tokenizer(name: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(name if "/" in name else tokenizer_path(name))
    own.no_truncation()
    own.no_padding()
    return own


class _Pieces(dict):
    """Codes of pieces of text, numbered by first appearance; the library encodes each piece once.

    The library cuts a text into words by a pattern that never looks back, and
    encodes each word by itself.  So the ids of a text are those of its pieces,
    if every cut is one that the pattern makes: a run of letters, digits or marks
    is a piece when what follows it surely ends it, and all else goes on to a
    space after what is surely no white space.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.fresh = tokenizer, []
        self.sizes = np.array([len(tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())], np.int64)  # a character stands for a byte
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.start, self.many, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self.start) + len(self.fresh)
        self.fresh.append(piece)
        return code

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode what is new; words that start with a space are put together, as the pattern cuts there."""
        worded = np.array([p[0] == " " and p[-1].isalpha() for p in self.fresh], bool)
        many, found = np.zeros(len(self.fresh), np.int64), [self.ids]
        words = [self.fresh[k] for k in np.flatnonzero(worded).tolist()]
        if words:
            (ids,) = self._library(["".join(words)])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
            many[worded] = np.diff(ends, prepend=0)
            found.append(ids)
        others = [self.fresh[k] for k in np.flatnonzero(~worded).tolist()]
        if others:
            coded = self._library(others)
            many[~worded] = [len(c) for c in coded]
            found += coded
        start = np.zeros(len(many), np.int64)
        placed = np.concatenate([np.flatnonzero(worded), np.flatnonzero(~worded)])
        start[placed] = len(self.ids) + np.cumsum(many[placed]) - many[placed]
        self.start, self.many = np.append(self.start, start), np.append(self.many, many)
        self.ids, self.fresh = np.concatenate(found), []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        if any(a in t for t in texts for a in self.added):
            return self._library(texts)
        cut = [_PIECE.findall(t) for t in texts]
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.fresh:
            self._learn()
        many = self.many[codes]
        ends = np.cumsum(many)
        out = self.ids[np.repeat(self.start[codes] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.append(0, ends)[np.cumsum([len(c) for c in cut])]
        if len(self) > PIECES or len(self.ids) > 8 * PIECES:
            self.clear()
            self.start, self.many, self.ids = self.start[:0], self.many[:0], self.ids[:0]
        return np.split(out, last[:-1])


def _encoded(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of rows (doc_id, text), a few texts at a time: the library's encodings are many times a text's size."""
    pieces = _Pieces(_tokenizer(name))
    end_id = np.array([END_ID], np.uint32)
    for batch in batches:
        doc_ids, texts = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= ENCODE_CHARS):
                size += len(texts[end])
                end += 1
            for doc_id, ids in zip(doc_ids[at:end], pieces.encode(texts[at:end]), strict=True):
                yield doc_id, np.concatenate([ids, end_id])
            at = end


def _index(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return nulls + np.array([[d or 0, n] for d, n in zip(doc_ids, lengths, strict=True)], "<i8").tobytes()


def _read_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, which are null, lengths)."""
    n = len(data) // 17
    table = np.frombuffer(data, "<i8", 2 * n, n).reshape(n, 2)
    return table[:, 0], np.frombuffer(data, np.uint8, n).astype(bool), table[:, 1]


def _write_segments(name: str):
    """Rows (doc_id, text) of a file in order, to its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, serial, at = TaskContext.get().partitionId(), 0, 0
        ready: list[tuple[list, list]] = []
        doc_ids, parts, size = [], [], 0

        def rows():
            nonlocal serial, at, ready
            whole = [np.concatenate(p) for _, p in ready]
            coded = encode_segments(whole)
            starts = at + np.cumsum([0, *map(len, whole)])
            index = [_index(d, [len(x) for x in p]) for d, p in ready]
            columns = [[file] * len(whole), list(range(serial, serial + len(whole))), starts[:-1].tolist(), [len(w) for w in whole], index, [b"".join(c) for c in coded]]
            serial, at, ready = serial + len(whole), int(starts[-1]), []
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _SEGMENTS.split(", ")])

        held = 0
        for doc_id, ids in _encoded(name, batches):
            doc_ids.append(doc_id)
            parts.append(ids)
            size += len(ids)
            if size >= SEGMENT:
                ready.append((doc_ids, parts))
                held += size
                doc_ids, parts, size = [], [], 0
            if held + SEGMENT > BLOCK * (LANES - LANES // 16):
                yield rows()
                held = 0
        if parts:
            ready.append((doc_ids, parts))
        if ready:
            yield rows()

    return run


def write(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE) -> None:
    """Encode ``docs`` and write files in ascending doc_id order: file k holds the k-th range of ids."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    files = partitions_for(spark, -(-chars // FILE_CHARS))
    first = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(files, first, F.substring("text", 1, PREFIX).asc())
    write_table(dealt.sortWithinPartitions(first, "text").mapInArrow(_write_segments(tokenizer), _SEGMENTS), path)


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to a row for each document; some of them are decoded side by side."""
    held: list[tuple] = []
    blocks = 0

    def rows(segments: list[tuple]) -> pa.RecordBatch:
        ids = decode_blocks([b for s in segments for b in s[4]])
        out, at = [], 0
        for file, start, n, index, _ in segments:
            doc_ids, nulls, lengths = _read_index(index)
            if lengths.sum() != n:
                raise ValueError(f"file {file}: the index and the blocks differ in length")
            ends = np.cumsum(lengths)
            raw = memoryview(ids[at : at + n].astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - x) : 4 * e]) for e, x in zip(ends.tolist(), lengths.tolist(), strict=True)]
            out.append((np.full(len(ends), file), doc_ids, nulls, start + ends - lengths, lengths, crc))
            at += n
        if at != len(ids):
            raise ValueError("the index and the blocks differ in length")
        file, doc_ids, nulls, start, lengths, crc = (np.concatenate(c) for c in zip(*out, strict=True))
        columns = [pa.array(file, pa.int32()), pa.array(doc_ids, mask=nulls), pa.array(start), pa.array(lengths), pa.array(crc.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    for batch in batches:
        for k in range(batch.num_rows):
            file, at, n, index, data = (c[k].as_py() for c in batch.columns)
            parts = split_blocks(data)
            if held and blocks + len(parts) > LANES:
                yield rows(held)
                held, blocks = [], 0
            held.append((file, at, n, index, parts))
            blocks += len(parts)
    if held:
        yield rows(held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    # a row for each file
    sizes = files.groupBy("file").agg(F.max(F.col("at") + F.col("ids")).alias("size"))
    starts = sizes.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    found = files.select("file", "at", "ids", "doc_ids", "blocks").mapInArrow(_read_segments, "file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
