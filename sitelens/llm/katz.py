"""Operator 7, language-model scoring: a Katz backoff bigram model over a whole corpus.

Counts are Good-Turing discounted, backoff weights normalise each context
exactly over the known words and one unknown word, and a text's score is the sum
of its tokens' log10 probabilities, each looked up recursively: the bigram, else
the context's weight times the unigram.

Texts are read once, into a table of blocks of up to BLOCK_TOKENS tokens (a longer text is
a block of its own); all later steps read that table, so a lost executor changes
nothing.  A block asks the owners of hash ranges for the corpus counts of its
distinct words, then of its distinct bigrams, in packed messages that carry its
own training counts; owners add up the messages and answer in their order.
Bigrams are owned by their context's range, those of frequent contexts by as many
ranges as the context's share of all tokens asks for, so no owner gets a hot word.

The number of ranges follows the number of tokens: an owner has about
RANGE_TOKENS in memory, whatever the size of the corpus.  Beyond FANOUT ranges
messages go in two levels: relays each take one group of blocks and one group of
ranges, merge equal keys on the way up and spread the answers on the way down,
so no block and no range has more than a few thousand messages.

Model tables (answers, context statistics and backoff weights) are written to
the shared folder, dealt by range.

Defined results: null texts are empty (one end token); repeated rows are scored,
and learned from, each; with nothing to learn from all probabilities are 1; no rows in, no rows
out; extra columns are ignored.  Words are told apart by 64-bit hashes, bigrams by both.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_for, remove_table

BLOCK_TOKENS = 1_000_000
#: Counts up to this one get Good-Turing discounts.
GT_MAX = 5
#: Tokens whose words and bigrams a range owns; a task has one range in memory.
RANGE_TOKENS = 2_000_000
#: Ranges that a block writes to directly; beyond, there are relays of GROUP blocks and GROUP ranges.
FANOUT = 4096
GROUP = 1024

_U = np.uint64
#: Stands for the place before the first token; sorts first.
START = _U(0)
END = _U(0xE0D0E0D0E0D0E0D1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEED = 7

#: kind: what ``data`` holds; ``to``: the block, relay or range that it goes to; ``sender``: the other one.
_MESSAGE = "kind int, to long, sender long, data binary"
REQUEST, ANSWER, TOTALS, HEAVY, CONTEXTS, COUNTS_OF_COUNTS, PAYLOAD, WORD_ANSWER, SEEN_AFTER = range(9)
_BLOCKS = "number long, size long, words binary, counts binary, payload binary"


# -- packing -------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        used = 8 - int(np.argmax((planes.any(axis=1))[::-1])) if planes.any() else 0
        data = zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())
        out.append(struct.pack("<IBI", len(a), used, len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, used, size = struct.unpack_from("<IBI", data, at)
        at += 9
        planes = np.zeros((8, n), np.uint8)
        planes[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8).reshape(used, n) if used else 0
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"))
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending.astype(_U), prepend=_U(0))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds, to, sender, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(to, pa.int64()), pa.array(sender, pa.int64()), pa.array(data, pa.binary())], names=["kind", "to", "sender", "data"])


class Plan:
    """Who owns what: the ranges of the hash space, the hot contexts, and the relays if there are two levels."""

    def __init__(self, tokens: int, blocks: int, at_least: int):
        self.ranges, self.group = max(at_least, -(-tokens // RANGE_TOKENS)), GROUP
        self.two_levels = self.ranges > FANOUT
        self.coarse = -(-self.ranges // self.group)
        self.groups = max(1, -(-blocks // self.group))
        self.hot, self.salts = np.zeros(0, _U), np.zeros(0, np.int64)

    def spread(self, words: np.ndarray, counts: np.ndarray, tokens: int) -> None:
        """Contexts with over a quarter of a range's share are dealt, by the second word, to ranges enough for a quarter each."""
        order = np.argsort(words)
        self.hot = words[order]
        self.salts = np.clip(np.ceil(counts[order] * (4.0 * self.ranges / max(tokens, 1))), 1, self.ranges).astype(np.int64)

    def home(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the like ranges of the hash space, in order."""
        return ((hashes >> _U(32)) * _U(self.ranges) >> _U(32)).astype(np.int64)

    def owner(self, context: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The range that owns each bigram (or word, with second 0)."""
        owner = self.home(context)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            on = np.flatnonzero(self.hot[at] == context)
            salts = self.salts[at[on]]
            salt = ((second[on] >> _U(20)) % salts.astype(_U)).astype(np.int64)
            owner[on] = (owner[on] + salt * (self.ranges // salts)) % self.ranges
        return owner

    def relay(self, block: int, owner: np.ndarray) -> np.ndarray:
        """Where a block's entries go: their owner, or the relay of the block's group and the owner's."""
        if not self.two_levels:
            return owner
        return (block * 0x9E3779B1 >> 8) % self.groups * self.coarse + owner // self.group


def pack_entries(context: np.ndarray, second: np.ndarray, count: np.ndarray) -> bytes:
    """Keys with their counts; equal contexts lie together."""
    cut = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    return pack(_steps(context[cut]), np.diff(np.r_[cut, len(context)]), second, count)


def unpack_entries(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(context, second, count) of all messages, and how many each has."""
    parts = [unpack(m) for m in messages]
    context = [np.repeat(np.cumsum(p[0], dtype=_U), p[1].astype(np.int64)) for p in parts]
    sizes = [len(c) for c in context]
    return np.concatenate(context), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.int64), sizes


def distinct(context: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct key, which key each entry has); keys are numbered in an order of their own."""
    mixed = (context ^ (context >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (second ^ (second >> _U(32))) * _U(0x94D049BB133111EB)
    _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
    if not (np.array_equal(context[first][which], context) and np.array_equal(second[first][which], second)):
        # two keys share a mixed number: sort by both columns
        order = np.lexsort((second, context))
        new = np.r_[True, (np.diff(context[order]) != 0) | (np.diff(second[order]) != 0)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
    return first, which


# -- blocks of documents --------------------------------------------------------------------------


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens, the end token last."""
    words = (text or "").encode().translate(_LOWER).split()
    out = np.empty(len(words) + 1, _U)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(_SEED)), _U, len(words))
    out[-1] = END
    return out


class Block:
    """Documents of one partition with their tokens; words are numbered in the order of their hashes."""

    def __init__(self, number: int, ids: list, held: list, lengths: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.number, self.ids, self.held, self.lengths, self.words, self.tokens = number, ids, held, lengths, words, tokens
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.train = np.repeat(~np.array(held, bool), lengths)

    @classmethod
    def of(cls, number: int, ids: list, held: list, parts: list[np.ndarray]) -> Block:
        words, tokens = np.unique(np.concatenate([np.array([START], _U), *parts]), return_inverse=True)
        return cls(number, ids, held, np.array([len(p) for p in parts], np.int64), words, tokens[1:].astype(np.int32))

    def word_counts(self) -> np.ndarray:
        """Training counts of the words; START counts documents."""
        counts = np.bincount(self.tokens[self.train], minlength=len(self.words))
        counts[0] = len(self.held) - sum(self.held)
        return counts

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct bigrams as context << 32 | word, which one each token ends)."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        return np.unique(before << 32 | self.tokens, return_inverse=True)

    def payload(self) -> bytes:
        known = np.array([i is not None for i in self.ids], _U)
        ids = np.array([i or 0 for i in self.ids], np.int64).view(_U)
        return pack(ids, known, np.array(self.held, _U), self.lengths, _steps(self.words), self.tokens)

    @classmethod
    def from_payload(cls, number: int, data: bytes) -> Block:
        ids, known, held, lengths, words, tokens = unpack(data)
        names = [int(i) if k else None for i, k in zip(ids.view(np.int64), known, strict=True)]
        return cls(number, names, held.astype(bool).tolist(), lengths.astype(np.int64), np.cumsum(words, dtype=_U), tokens.astype(np.int32))


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Blocks of this partition from rows (doc_id, held_out, text)."""
    ids, held, parts, size, serial = [], [], [], 0, 0
    base = TaskContext.get().partitionId() << 20
    for batch in batches:
        for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = word_hashes(t)
            if parts and size + len(own) > most:
                yield Block.of(base + serial, ids, held, parts)
                ids, held, parts, size, serial = [], [], [], 0, serial + 1
            ids.append(i)
            held.append(h)
            parts.append(own)
            size += len(own)
    if parts:
        yield Block.of(base + serial, ids, held, parts)


def _read_blocks(most: int):
    def run(batches):
        for block in blocks(batches, most):
            columns = [[block.number], [len(block.tokens)], [pack(_steps(block.words))], [pack(block.word_counts())], [block.payload()]]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["number", "size", "words", "counts", "payload"])

    return run


def _runs(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values."""
    if len(owner):
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        yield from zip(owner[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(owner)], strict=True)


def _requests(plan: Plan, number: int, context: np.ndarray, second: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A block's messages; its entries are in ascending order of context, then second."""
    owner = plan.owner(context, second)
    order = np.argsort(owner, kind="stable")
    to = plan.relay(number, owner[order])
    return _rows([(REQUEST, t, number, pack_entries(*(x[order[a:b]] for x in (context, second, counts)))) for t, a, b in _runs(to)])


def _word_requests(plan: Plan):
    """Over rows (number, words, counts)."""

    def run(batches):
        for batch in batches:
            for number, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = np.cumsum(unpack(words)[0], dtype=_U)
                yield _requests(plan, number, hashes, np.zeros(len(hashes), _U), unpack(counts)[0])

    return run


def _bigram_requests(plan: Plan):
    """Over rows (number, payload)."""

    def run(batches):
        for batch in batches:
            for number, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.from_payload(number, payload)
                pairs, which = block.bigrams()
                yield _requests(plan, number, block.words[pairs >> 32], block.words[pairs & 0xFFFFFFFF], np.bincount(which[block.train], minlength=len(pairs)))

    return run


# -- relays and owners of ranges --------------------------------------------------------------------


def _groups(batches) -> Iterator[tuple[int, list[tuple]]]:
    """(to, [(kind, sender, data)]) of rows sorted by ``to``."""
    to, held = None, []
    for batch in batches:
        for kind, t, sender, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != to:
                if held:
                    yield to, held
                to, held = t, []
            held.append((kind, sender, data))
    if held:
        yield to, held


def _cut(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _of_kind(messages: list[tuple], kind: int) -> list[tuple[int, bytes]]:
    """(sender, data) in the order of senders."""
    return sorted((sender, data) for k, sender, data in messages if k == kind)


def _merged(plan: Plan, asked: list[tuple[int, bytes]]):
    """What a relay was asked: (context, second, count, owner) of the distinct keys in the order it sends them, and of the entries (key, is its first, sizes)."""
    context, second, count, sizes = unpack_entries([data for _, data in asked])
    first, which = distinct(context, second)
    order = np.lexsort((second[first], context[first], plan.owner(context[first], second[first])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    total = np.bincount(which, weights=count.astype(np.float64)).astype(np.int64)
    lead = np.zeros(len(context), bool)
    lead[first] = True
    own = first[order]
    return (context[own], second[own], total[order], plan.owner(context[own], second[own])), (place[which], lead, sizes)


def _relay_up(plan: Plan):
    """Relays ask the owners for the distinct keys of their blocks."""

    def run(batches):
        for relay, messages in _groups(batches):
            (context, second, count, owner), _ = _merged(plan, _of_kind(messages, REQUEST))
            yield _rows([(REQUEST, to, relay, pack_entries(context[a:b], second[a:b], count[a:b])) for to, a, b in _runs(owner)])

    return run


def _relay_down(plan: Plan):
    """Relays tell their blocks what the owners answered."""

    def run(batches):
        for relay, messages in _groups(batches):
            asked = _of_kind(messages, REQUEST)
            _, (key, lead, sizes) = _merged(plan, asked)
            total, mine = (np.concatenate(x) for x in zip(*(unpack(data) for _, data in _of_kind(messages, ANSWER)), strict=True))
            out = zip(asked, _cut(total[key], sizes), _cut(mine[key] * lead, sizes), strict=True)
            yield _rows([(ANSWER, sender, relay, pack(t, m)) for (sender, _), t, m in out])

    return run


def _owned(asked: list[tuple[int, bytes]]):
    """Distinct keys of a range as (context, second, count in the corpus), and the answer to each sender: counts, and which entries account for a key."""
    context, second, count, sizes = unpack_entries([data for _, data in asked])
    first, which = distinct(context, second)
    total = np.bincount(which, weights=count.astype(np.float64), minlength=len(first)).astype(np.int64)
    mine = np.zeros(len(context), np.uint8)  # each key is accounted for by the first sender that has it
    mine[first] = total > 0
    answers = [(sender, pack(t, m)) for (sender, _), t, m in zip(asked, _cut(total[which], sizes), _cut(mine, sizes), strict=True)]
    return (context[first], second[first], total), answers


def _word_owner(heavy_share: int):
    """Corpus counts of words, the range's totals, and its words with 1 / heavy_share of its tokens or more."""

    def run(batches):
        for to, messages in _groups(batches):
            (words, _, total), answers = _owned(_of_kind(messages, REQUEST))
            real = words != START
            tokens = int(total[real].sum())
            heavy = real & (total * heavy_share >= max(tokens, 1)) & (total > 0)
            out = [(ANSWER, sender, to, data) for sender, data in answers]
            out += [(TOTALS, 0, tokens, None), (TOTALS, 1, int((total[real] > 0).sum()), None), (TOTALS, 2, int(total[~real].sum()), None)]
            out += [(HEAVY, int(w), int(n), None) for w, n in zip(words[heavy].view(np.int64), total[heavy], strict=True)]
            yield _rows(out)

    return run


def _bigram_owner(plan: Plan):
    """Corpus counts of bigrams, statistics of their contexts, and how many bigrams have each small count."""

    def run(batches):
        for to, messages in _groups(batches):
            (context, _, total), answers = _owned(_of_kind(messages, REQUEST))
            contexts, local = np.unique(context, return_inverse=True)
            seen = total > 0
            local, total = local[seen], total[seen]
            stats = [np.bincount(local[total == r], minlength=len(contexts)) for r in range(1, GT_MAX + 1)]
            large = total > GT_MAX
            stats += [np.bincount(local[large], minlength=len(contexts)), np.bincount(local[large], weights=total[large].astype(np.float64), minlength=len(contexts)).astype(np.int64)]
            out = [(ANSWER, sender, to, data) for sender, data in answers]
            out += [(CONTEXTS, home, to, pack(_steps(contexts[a:b]), *(s[a:b] for s in stats))) for home, a, b in _runs(plan.home(contexts))]
            out += [(COUNTS_OF_COUNTS, r, int((total == r).sum()), None) for r in range(1, GT_MAX + 2)]
            yield _rows(out)

    return run


# -- the model --------------------------------------------------------------------------------------


class Discounts:
    """Discount factors: Good-Turing up to GT_MAX, a constant less beyond.

    Where counts of counts are too few for Good-Turing (a small corpus) the
    constant is taken off all counts.  It keeps some mass for words unseen after
    contexts all of whose continuations are frequent.
    """

    def __init__(self, counts_of_counts: list[int]):
        n = counts_of_counts
        self.less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        factors = []
        if all(n) and (a := (GT_MAX + 1) * n[GT_MAX] / n[0]) < 1:
            factors = [((r + 1) * n[r] / (n[r - 1] * r) - a) / (1 - a) for r in range(1, GT_MAX + 1)]
        if not factors or not all(0 < f < 1 for f in factors):
            factors = [(r - self.less) / r for r in range(1, GT_MAX + 1)]
        self.factors = factors

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts of counts of 1 and more."""
        table = np.array([0.0, *(r * f for r, f in enumerate(self.factors, 1))])
        return np.where(counts > GT_MAX, counts - self.less, table[np.minimum(counts, GT_MAX)])


class Unigrams:
    """Add-half word probabilities over the known words and one unknown word."""

    def __init__(self, tokens: int, words: int):
        self.tokens, self.words = tokens, words
        self.mass = tokens + 0.5 * (words + 1)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.mass)


def _context_sums(messages: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with their summed statistics and what was seen after them."""
    parts = [(kind, unpack(data)) for kind, _, data in messages]
    contexts, local = np.unique(np.concatenate([np.cumsum(a[0], dtype=_U) for _, a in parts]), return_inverse=True)
    small = np.zeros((GT_MAX + 2, len(contexts)), np.int64)
    after = np.zeros((2, len(contexts)), np.int64)
    at = 0
    for kind, arrays in parts:
        own = local[at : at + len(arrays[0])]
        at += len(own)
        for row, values in zip(small if kind == CONTEXTS else after, arrays[1:], strict=True):
            np.add.at(row, own, values.astype(np.int64))
    return contexts, small, after


def _relay_after(plan: Plan):
    """Relays add up what blocks saw after a context."""

    def run(batches):
        for relay, messages in _groups(batches):
            contexts, _, after = _context_sums(messages)
            yield _rows([(SEEN_AFTER, to, relay, pack(_steps(contexts[a:b]), *after[:, a:b])) for to, a, b in _runs(plan.home(contexts))])

    return run


def _weights(unigrams: Unigrams, discounts: Discounts):
    """Owners of contexts: log10 of the backoff weight from all statistics of a context."""

    def run(batches):
        for _, messages in _groups(batches):
            contexts, small, after = _context_sums(messages)
            r = np.arange(1, GT_MAX + 1)[:, None]
            total = (small[:GT_MAX] * r).sum(axis=0) + small[GT_MAX + 1]
            kept = (small[:GT_MAX] * r * np.array(discounts.factors)[:, None]).sum(axis=0) + small[GT_MAX + 1] - discounts.less * small[GT_MAX]
            known = total > 0
            left = 1 - kept[known] / total[known]
            unseen = 1 - (after[0][known] + 0.5 * after[1][known]) / unigrams.mass
            yield pa.RecordBatch.from_arrays([pa.array(contexts[known].view(np.int64)), pa.array(np.log10(left / unseen))], names=["context", "log_weight"])

    return run


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, seen_score double, backoff array<long>, to long, after binary"


def _score(unigrams: Unigrams, discounts: Discounts, plan: Plan):
    """Blocks with their answers to scored documents.

    ``seen_score`` lacks the weights of the contexts in ``backoff``.  Rows with
    ``after`` carry, to the owner of a context, the unigram counts of the words
    that follow it, from the block that accounts for the bigram.
    """

    def run(batches):
        for number, messages in _groups(batches):
            block = Block.from_payload(number, next(data for kind, _, data in messages if kind == PAYLOAD))
            pairs, which = block.bigrams()
            order = np.argsort(plan.owner(block.words[pairs >> 32], block.words[pairs & 0xFFFFFFFF]), kind="stable")
            words = np.concatenate([unpack(data)[0] for _, data in _of_kind(messages, WORD_ANSWER)]).astype(np.int64)
            counts, mine = (np.concatenate(x) for x in zip(*(unpack(data) for _, data in _of_kind(messages, ANSWER)), strict=True))
            if len(words) != len(block.words) or len(counts) != len(pairs):
                raise RuntimeError("a block lacks answers")
            total, own = np.empty(len(pairs), np.int64), np.empty(len(pairs), bool)
            total[order], own[order] = counts.astype(np.int64), mine.astype(bool)
            context, second = pairs >> 32, pairs & 0xFFFFFFFF
            base = unigrams.log10(words)
            score = base[second].copy()
            seen = total > 0
            score[seen] = np.log10(discounts.discounted(total[seen]) / words[context[seen]])
            backs = ~seen & (words[context] > 0)
            sums = lambda values: np.add.reduceat(values, block.starts)
            at = np.flatnonzero(backs[which])
            doc = np.searchsorted(block.ends, at, side="right")
            contexts = block.words[context[which[at]]].view(np.int64)
            cuts = np.searchsorted(doc, np.arange(len(block.ids) + 1))
            n = len(block.ids)
            none = lambda kind: pa.nulls(n, kind)
            fields = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "seen_score", "backoff", "to", "after"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((number << 22) + np.arange(n)),
                    pa.array(block.ids, pa.int64()),
                    pa.array(block.held, pa.bool_()),
                    pa.array(block.lengths),
                    pa.array(sums((words[block.tokens] > 0).astype(np.int64))),
                    pa.array(sums(base[block.tokens])),
                    pa.array(sums(score[which])),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(contexts)),
                    none(pa.int64()),
                    none(pa.binary()),
                ],
                names=fields,
            )
            # contexts are numbered in hash order, and bigrams are sorted by context
            number_of, first = np.unique(context[own], return_index=True)
            if len(number_of):
                follow = np.add.reduceat(words[second[own]], first)
                many = np.diff(np.r_[first, int(own.sum())])
                hashes = block.words[number_of]
                sent = [(to, pack(_steps(hashes[a:b]), follow[a:b], many[a:b])) for to, a, b in _runs(plan.relay(number, plan.home(hashes)))]
                m = len(sent)
                empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([t for t, _ in sent], pa.int64()), pa.array([d for _, d in sent], pa.binary())], names=fields)

    return run


def held_out(fold: int = 1, folds: int = 5) -> Column:
    """Rows whose crc32(doc_id as text) mod ``folds`` is ``fold`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def _deal(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "to").sortWithinPartitions("to", "sender", "kind")


def _exchange(requests: DataFrame, owner, plan: Plan, parts: int, what: str) -> DataFrame:
    """Blocks' requests to what the owners of ranges make of them; ANSWER rows are to blocks."""
    if not plan.two_levels:
        return materialise(_deal(requests, parts).mapInArrow(owner, _MESSAGE), what)
    asked = materialise(requests, f"{what}-asked")
    owned = materialise(_deal(_deal(asked, parts).mapInArrow(_relay_up(plan), _MESSAGE), parts).mapInArrow(owner, _MESSAGE), f"{what}-owned")
    to_relays = owned.filter(F.col("kind") == ANSWER)
    spread = _deal(asked.union(to_relays), parts).mapInArrow(_relay_down(plan), _MESSAGE)
    out = materialise(spread.union(owned.filter(F.col("kind") != ANSWER)), what)
    remove_table(asked)
    remove_table(owned)
    return out


def _sums(messages: DataFrame, kind: int) -> dict[int, int]:
    """Sums of the numbers that owners sent as ``sender``, by ``to``."""
    return {r["to"]: int(r["n"]) for r in messages.filter(F.col("kind") == kind).groupBy("to").agg(F.sum("sender").alias("n")).collect()}


def score_documents(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held``: rows that are scored but not learned from.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", (held_out() if held is None else held).alias("held_out"), "text")
    read = materialise(texts.mapInArrow(_read_blocks(BLOCK_TOKENS), _BLOCKS), "blocks")
    size = read.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("blocks")).first()
    plan = Plan(size["tokens"], size["blocks"], partitions_for(spark))
    parts = plan.ranges

    words = _exchange(read.select("number", "words", "counts").mapInArrow(_word_requests(plan), _MESSAGE), _word_owner(max(4096, 4 * plan.ranges)), plan, parts, "word-counts")
    totals = _sums(words, TOTALS)
    unigrams = Unigrams(totals.get(0, 0), totals.get(1, 0))
    # at most 4 * ranges words can have that share of all tokens; so can START
    share = F.col("sender").cast("double") * 4 * plan.ranges >= max(unigrams.tokens, 1)
    heavy = words.filter((F.col("kind") == HEAVY) & share).select("to", "sender").collect()
    hot = [(START, totals.get(2, 0)), *((_U(r["to"] % (1 << 64)), r["sender"]) for r in heavy)]
    plan.spread(np.array([w for w, _ in hot], _U), np.array([n for _, n in hot], np.int64), unigrams.tokens)

    bigrams = _exchange(read.select("number", "payload").mapInArrow(_bigram_requests(plan), _MESSAGE), _bigram_owner(plan), plan, parts, "bigram-counts")
    counts_of_counts = _sums(bigrams, COUNTS_OF_COUNTS)
    discounts = Discounts([counts_of_counts.get(r, 0) for r in range(1, GT_MAX + 2)])

    payloads = read.select(F.lit(PAYLOAD).alias("kind"), F.col("number").alias("to"), F.lit(-1).cast("long").alias("sender"), F.col("payload").alias("data"))
    word_answers = words.filter(F.col("kind") == ANSWER).withColumn("kind", F.lit(WORD_ANSWER))
    met = _deal(payloads.union(word_answers).union(bigrams.filter(F.col("kind") == ANSWER)), parts)
    scored = materialise(met.mapInArrow(_score(unigrams, discounts, plan), _SCORED), "scored")
    remove_table(read)
    remove_table(words)

    after = scored.filter(F.col("after").isNotNull()).select(F.lit(SEEN_AFTER).alias("kind"), "to", F.lit(-1).cast("long").alias("sender"), F.col("after").alias("data"))
    if plan.two_levels:
        after = _deal(after, parts).mapInArrow(_relay_after(plan), _MESSAGE)
    stats = bigrams.filter(F.col("kind") == CONTEXTS).union(after)
    weights = materialise(_deal(stats, parts).mapInArrow(_weights(unigrams, discounts), "context long, log_weight double"), "backoff-weights")
    remove_table(bigrams)

    rows = scored.filter(F.col("row").isNotNull()).drop("to", "after")
    backs = rows.select("row", F.explode("backoff").alias("context")).groupBy("row", "context").agg(F.count(F.lit(1)).alias("times"))
    extra = backs.join(weights, "context").groupBy("row").agg(F.sum(F.col("times") * F.col("log_weight")).alias("extra"))
    out = rows.drop("backoff").join(extra, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("seen_score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
