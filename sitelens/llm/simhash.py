"""Operator 1, SimHash near-duplicates: bit-sliced comparison inside agreeing-block buckets.

Fingerprints within the radius agree in whole blocks of bits, so rows meet in
buckets of equal blocks (an exact scheme: no link is missed).  Inside buckets
the fingerprints are stored as vertical bit planes; a plane against itself,
shifted by s lanes, compares every row with the row s places on, 64 lanes a
word.  Differences are added up in carry-save bit counters, and words are
abandoned once all their lanes exceed the radius.  Only links that join two
groups are emitted, never all pairs of a bucket; buckets beyond CELL rows are
dealt out as pairs of chunks.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows give a row each; a component whose doc_ids are all null has
a null component_id; no rows in, no rows out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialise, remove_table
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this many fingerprints are compared in one place, larger ones chunk by chunk.
CELL = 4096
#: Rows that a task compares at once.
BATCH = 1 << 19

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# -- fingerprints ---------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text; bytes.split() splits at exactly the six spaces."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes (none: 0)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
def _fingerprint(text: pa.Array) -> pa.Array:
    found = [majority_bits(shingle_hashes(t)) if t else 0 for t in text.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """SimHash of a text column, as a signed long of the same 64 bits."""
    return _fingerprint(text)


# -- bit-sliced comparison ----------------------------------------------------------------


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane b is bit b of fingerprint i; one spare word at the end."""
    words = len(fps) // 64 + 2
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.zeros((64, words * 8), np.uint8)
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    packed[:, : rows.shape[1]] = rows
    return packed.view("<u8")


def _pack(lanes: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    bits = np.packbits(lanes, bitorder="little")
    out[: len(bits)] = bits
    return out.view("<u8")


def near_at_shift(planes: np.ndarray, wanted: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Lanes i of ``wanted`` (boolean) whose fingerprint differs from that of i+shift in ``radius`` bits at most."""
    words = planes.shape[1]
    depth = radius.bit_length()
    alive = _pack(wanted, words)
    at = np.flatnonzero(alive)
    alive = alive[at]
    skip, low = divmod(shift, 64)
    counters = [np.zeros(len(at), np.uint64) for _ in range(depth)]
    over = np.zeros(len(at), np.uint64)
    low_shift, high_shift = np.uint64(low), np.uint64(64 - low)
    for b in range(64):
        plane = planes[b]
        there = plane[np.minimum(at + skip, words - 1)]
        if low:
            there = (there >> low_shift) | (plane[np.minimum(at + skip + 1, words - 1)] << high_shift)
        carry = plane[at] ^ there
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            hold = (alive & ~over) != 0
            if not hold.all():
                at, alive, over = at[hold], alive[hold], over[hold]
                counters = [c[hold] for c in counters]
                if not len(at):
                    return np.zeros(0, np.int64)
    # lanes beyond the radius though not beyond the counters (none when radius is 2**k - 1)
    left = alive & ~over
    lanes = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    word, bit = np.nonzero(lanes)
    return at[word] * 64 + bit


def near_pairs(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, wanted: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of one bucket within the radius, over rows sorted by bucket; ``wanted(i, j)`` says which pairs are still asked for."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    rows, size = np.arange(n), np.repeat(sizes, sizes)
    end = np.repeat(starts + sizes, sizes)
    shift = 1
    while True:
        hold = size > shift  # buckets that still have rows so far apart; whole buckets stay together
        rows, size, end = rows[hold], size[hold], end[hold]
        if not len(rows):
            return
        planes, stop = _planes(fps[rows]), 2 * shift
        while shift < stop:
            here, there = rows[:-shift], rows[shift:]
            ask = there < end[:-shift]
            if wanted is not None:
                ask &= wanted(here, there)
            if ask.any():
                i = near_at_shift(planes, ask, shift, radius)
                i = i[np.bitwise_count(fps[rows[i]] ^ fps[rows[i + shift]]) <= radius]
                yield rows[i], rows[i + shift]
            shift += 1
            if shift >= len(rows):
                return


def linked_groups(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by bucket: the index of the first row linked to each, by links inside its bucket."""
    group = np.arange(len(fps))
    for i, j in near_pairs(bucket, fps, radius, lambda a, b: group[a] != group[b]):
        group[:] = _merge(group, i, j)
    return group


def _merge(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the groups of a[i] and b[i]; a group is named by its smallest member."""
    while len(a):
        ga, gb = group[a], group[b]
        apart = ga != gb
        a, b, ga, gb = a[apart], b[apart], ga[apart], gb[apart]
        if not len(a):
            break
        np.minimum.at(group, np.maximum(ga, gb), np.minimum(ga, gb))
        while True:
            up = group[group]
            if np.array_equal(up, group):
                break
            group = up
    return group


def _link_batches(batches):
    """Over rows sorted by bucket: a link from each fingerprint to the first of its group."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(key, fps):
        group = linked_groups(key, fps)
        moved = np.flatnonzero(group != np.arange(len(group)))
        return pa.RecordBatch.from_arrays([pa.array(fps[group[moved]].view(np.int64)), pa.array(fps[moved].view(np.int64))], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        if sum(len(k) for k, _ in held) < BATCH:
            continue
        key, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
        if cut:
            yield compare(key[:cut], fps[:cut])
        held = [(key[cut:], fps[cut:])]
    if held:
        key, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key):
            yield compare(key, fps)


# -- buckets and components ------------------------------------------------------------------


def bucket_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of agreeing blocks: 64 bits in m blocks, each mask has m - radius of them.

    Fingerprints within the radius leave m - radius blocks untouched, whatever
    m is.  m grows with the rows so that a bucket of chance agreements stays small.
    """
    m = next((m for m in range(radius + 1, 2 * radius + 3) if rows < 2 ** (64 * (m - radius) // m) * 64), 2 * radius + 2)
    edges = [64 * k // m for k in range(m + 1)]
    blocks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(m)]
    return [sum(blocks[k] for k in c) for c in combinations(range(m), m - radius)]


def near_links(fps: DataFrame, rows: int, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all that lie within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in bucket_masks(rows, radius)]
    masks = F.array(*(F.lit(m) for m in signed))
    keyed = fps.select("fp", F.posexplode(masks).alias("c", "mask")).select("fp", F.xxhash64("c", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
    keyed = materialise(keyed, "keyed")
    large = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    chunks = F.ceil(F.col("n") / cell * 2).cast("int")
    dealt = keyed.join(large, "k", "left").withColumn("_i", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    cells = F.when(F.col("n").isNull(), F.array(F.col("k"))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("k", F.least(j, F.col("_i")), F.greatest(j, F.col("_i"))))
    )
    dealt = dealt.select(F.explode(cells).alias("cell"), "fp")
    links = materialise(dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_link_batches, "a long, b long").distinct(), "links")
    remove_table(keyed)
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable."""
    marked = materialise(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    first = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = near_links(first.select("fp"), first.count(), radius)
    roots = connected_components(links)
    remove_table(links)
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with its smallest doc_id.

    Rows without a doc_id can't be told apart and stay.  Repeated rows of one
    doc_id count as copies: one of them stays.
    """
    return keep_least(docs, near_duplicates(docs, radius))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id that ``found`` gives them, and those without a doc_id."""
    found = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    found = materialise(found, "kept")
    # by shuffle at every size, so that a small run tells what a large one will move
    stay = docs.join(found.select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    if not found.filter("_rows > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    nameless = docs.filter(F.col("doc_id").isNull())
    return stay if nameless.isEmpty() else stay.unionByName(nameless)
