"""Operator 10, document fingerprints: MinHash over word shingles, bands and verified Jaccard.

A text's shingles are its runs of SHINGLE words; the first words come with start
marks before them, so a text of n words has n shingles and short texts have some
too.  Shingles of many documents are hashed at once from their bytes, put
through PERMUTATIONS multiply-shift hash functions in numpy, and the minimum of
each function over a document is its signature.  A fingerprint is the signature's
lower 16 bits each, in hex (the upper bits of minima over long texts are nearly
all zero); likeness is the share of equal places.

Signature bands are joined in Spark, and candidates verified by the exact Jaccard
similarity of their shingle sets, by ``neardup.classes``.

Defined results: null is an empty text; texts without words share one signature and are alike;
rows of one doc_id follow each other by text, null doc_ids come last; a single
row is its own next document; a long text is hashed in pieces; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, range_bounds, range_of

SHINGLE = 5
PERMUTATIONS = 128
SEED = 20_240
BANDS = 25
BAND_ROWS = 5
#: Bytes of text hashed at once.
CHUNK_BYTES = 4 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, count, dtype=_U)


_MULTIPLY, _ADD = _functions(PERMUTATIONS, SEED)


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes[bounds[i]:bounds[i+1]] are the shingles of text i, one for each word."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    letter = ~_SPACE[data]
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    first, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    power = np.empty(len(data), _U)
    power[0] = 1
    power[1:] = _BASE
    np.cumprod(power, out=power)
    inverse = np.empty(len(data), _U)
    inverse[0] = 1
    inverse[1:] = _INVERSE
    np.cumprod(inverse, out=inverse)
    summed = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power, out=summed[1:])
    words = _mix((summed[stop] - summed[first]) * inverse[first] + (stop - first).astype(_U))
    bounds = np.r_[0, np.searchsorted(first, ends_of_text)]
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    hashes = words.copy()
    for k in range(1, size):
        before = np.full(len(words), k, _U)
        ok = place >= k
        before[ok] = words[np.flatnonzero(ok) - k]
        hashes = _mix(hashes * _U(0xD6E8FEB86659FD93) + before)
    return hashes, bounds


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of at most CHUNK_BYTES, or of one text."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def pieces(text: bytes, size: int = SHINGLE) -> Iterator[bytes]:
    """A text in pieces of about CHUNK_BYTES, cut between words; each but the first begins with the last size - 1 words before it."""
    at, before = 0, b""
    while at < len(text):
        end = len(text) if len(text) - at <= CHUNK_BYTES else next((m.end() for m in _GAP.finditer(text, at + CHUNK_BYTES)), len(text))
        piece = before + text[at:end]
        yield piece
        at, before = end, b" ".join(piece.rsplit(None, size - 1)[-(size - 1) :]) + b" "


def hashed(texts: list[bytes], shingles: Callable = shingle_hashes, repeated: int = SHINGLE - 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, bounds) of runs of texts, a bounded number of bytes at a time; a long text comes in several.

    ``repeated``: how many shingles at the start of a later piece belong to the one before.
    """
    at = 0
    for part in chunks(texts):
        if len(part) > 1 or len(part[0]) <= CHUNK_BYTES:
            yield at, *shingles(part)
        else:
            for k, piece in enumerate(pieces(part[0])):
                hashes, _ = shingles([piece])
                own = hashes[repeated:] if k else hashes
                yield at, own, np.array([0, len(own)])
        at += len(part)


def signatures(texts: list[bytes], shingles: Callable = shingle_hashes, repeated: int = SHINGLE - 1) -> np.ndarray:
    """(texts, PERMUTATIONS) minima as 32-bit numbers; without shingles all ones."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for at, hashes, bounds in hashed(texts, shingles, repeated):
        _minima(hashes, bounds, out[at : at + len(bounds) - 1])
    return out


def shingle_sets(texts: list[bytes], shingles: Callable = shingle_hashes, repeated: int = SHINGLE - 1) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    out: list = [np.zeros(0, _U)] * len(texts)
    for at, hashes, bounds in hashed(texts, shingles, repeated):
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False), at):
            found = np.unique(hashes[a:b])
            out[k] = np.union1d(out[k], found) if len(out[k]) else found
    return out


def _minima(hashes: np.ndarray, bounds: np.ndarray, out: np.ndarray, step: int = 1 << 15) -> None:
    """Minimum of each hash function over each text, a cache-sized piece of shingles at a time."""
    for a in range(0, len(hashes), step):
        part = hashes[a : a + step]
        first = int(np.searchsorted(bounds, a, side="right")) - 1
        last = int(np.searchsorted(bounds, a + len(part), side="left"))
        starts = np.maximum(bounds[first:last] - a, 0)
        full = np.flatnonzero(np.diff(np.r_[starts, len(part)]) > 0)
        rows = first + full
        for j in range(PERMUTATIONS):
            low = np.minimum.reduceat(((part * _MULTIPLY[j] + _ADD[j]) >> _U(32)).astype(np.uint32), starts[full])
            out[rows, j] = np.minimum(out[rows, j], low)


def fingerprints(signature: np.ndarray) -> list[str]:
    """Hex of the lower 16 bits of each minimum."""
    rows = (signature & np.uint32(0xFFFF)).astype(">u2")
    return [r.tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal fingerprint places, row by row."""
    return (a.astype(np.uint16) == b.astype(np.uint16)).mean(axis=1)


# -- fingerprints of documents, of edited texts and of the next document --------------------------

_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
#: ``text`` is null in a row that tells the class of the doc_id's text with this hash; such rows come before the doc_id's texts.
_ROWS = ("bucket", "doc_id", "guest", "text", "node", "class_id")


def edited_text(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROWS in order; a guest row only serves as the next of the one before."""
    held: list[tuple] = []
    owner, classes = None, {}

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        # the last row stays behind; a guest is followed by another bucket
        own = [i for i in range(len(rows) - 1) if not rows[i][2]]
        raw = [r[3].encode() for r in rows]
        edited = [edited_text(rows[i][3], rows[i + 1][3]).encode() for i in own]
        plain, changed = signatures(raw), signatures(edited)
        names = fingerprints(plain)
        at, after = np.array(own, np.int64), np.array(own, np.int64) + 1
        columns = [
            pa.array([rows[i][1] for i in own], pa.int64()),
            pa.array([len(rows[i][3]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([names[i] for i in own], pa.string()),
            pa.array(fingerprints(changed), pa.string()),
            pa.array(likeness(plain[at], changed) if own else [], pa.float64()),
            pa.array(likeness(plain[at], plain[after]) if own else [], pa.float64()),
            pa.array([rows[i][4] for i in own], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _FIELDS.split(", ")])

    size = 0
    for batch in batches:
        for bucket, doc_id, guest, text, node, class_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, doc_id) != owner:
                owner, classes = (bucket, doc_id), {}
            if text is None:
                classes[node] = class_id
                continue
            row = (bucket, doc_id, guest, text, classes.get(text_hash(text)) if classes else None)
            if held and held[-1][2] and guest and held[-1][0] == bucket:
                continue  # a further guest of the same bucket
            held.append(row)
            size += len(row[3])
            if size >= CHUNK_BYTES and len(held) > 1:
                yield flush(held)
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield flush(held)


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def edit_report(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how both and the next document's compare.

    ``classes``: (doc_id, node, class_id), the class of each document's text by
    its hash, as ``neardup.classes`` finds them; it comes out as ``class_id``
    (without it null).  Class rows are dealt and sorted with the texts they belong
    to, so texts move once.

    The next document is the next smaller doc_id; after the smallest comes the
    largest.  Rows are dealt to ranges of doc_id; the first row of a range also
    goes, as a guest, to the end of the range before.  Only range bounds and the
    first ids of ranges reach the driver.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(named, "doc_id", 2 * partitions_for(spark))
    # bucket 0 has the largest ids; null ids come last, with the smallest
    placed = named.withColumn("bucket", F.lit(len(bounds)) - range_of(F.col("doc_id"), bounds))
    firsts = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    used = sorted(firsts)
    none = [F.lit(None).cast("long").alias(c) for c in _ROWS[4:]]
    if not used:
        return placed.select("bucket", "doc_id", F.lit(0).alias("guest"), "text", *none).mapInArrow(_compare, _FIELDS)
    # the first row of a bucket is a guest at the end of the bucket before it
    hosts = spark.createDataFrame([(after, firsts[after], here) for here, after in zip(used, used[1:] + used[:1], strict=True)], "b int, top long, host int")
    hosts = F.broadcast(hosts)  # a row for each bucket
    dealt = placed.join(hosts, (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("host").isNotNull(), F.array(own, F.struct(F.col("host").alias("b"), F.lit(1).alias("g")))).otherwise(F.array(own))))
    rows = dealt.select(F.col("_to.b").alias("bucket"), "doc_id", F.col("_to.g").alias("guest"), "text", *none)
    if classes is not None:
        told = classes.select("doc_id", "node", "class_id").distinct().withColumn("bucket", F.lit(len(bounds)) - range_of(F.col("doc_id"), bounds))
        rows = rows.unionByName(told.select("bucket", "doc_id", F.lit(0).alias("guest"), F.lit(None).cast("string").alias("text"), "node", "class_id"))
    ordered = rows.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(_compare, _FIELDS)


# -- signature bands ------------------------------------------------------------------------------


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands of each signature."""
    rows = signature[:, : BANDS * BAND_ROWS].astype(_U).reshape(len(signature), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(signature), BANDS)).copy()
    for k in range(BAND_ROWS):
        keys = _mix(keys * _U(0xD6E8FEB86659FD93) + rows[:, :, k])
    return keys
