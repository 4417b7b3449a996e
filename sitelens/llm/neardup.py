"""Near copies: documents whose 5-word shingle sets have an exact Jaccard similarity of 0.8 or more.

SimHash at a similarity of 0.8 lies about 10 of 64 bits apart, too far for blocks
of bits that must agree.  So texts meet where they share a band of MinHash
minima: the components of such candidates are dealt to cells, each text once.
Inside cells SimHash fingerprints of the shingle sets are compared as operator 1
does, in vertical bit planes with carry-save counters, at a radius of RADIUS
bits, and pairs within it are verified exactly; only links that join two groups are
emitted.  Components beyond CELL texts are dealt by band instead, bands beyond
CELL as pairs of chunks, so that no task holds many more than CELL sets.

PLAIN shingles are those of the pipeline: words of operator 1 (six spaces, ASCII
lower case), five in a row, a text of fewer is one shingle.  PADDED ones are those
of operator 10's signatures.  A pair of similarity 0.8 shares no band with
probability (1 - 0.8**5)**25 = 0.00005, any nearer pair with less; it lies beyond
the radius with about 0.000001.  Sets under SMALL shingles, whose bits are noisy, are all verified.

Defined results: null is an empty text; texts without words are alike; rows
without a doc_id are compared but name no class (``near_copies`` and ``keep_first``
leave them alone); repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import minhash, simhash
from .common import materialise, remove_table
from .components import connected_components
from .simhash import _LOWER, _merge, keep_least

SHINGLE = 5
MIN_JACCARD = 0.8
#: Texts that are compared in one place at most.
CELL = 4096
#: Bits that fingerprints of alike sets may differ in, and the set size from which they are asked.
RADIUS = 24
SMALL = 24
#: Pairs that are held before they are verified, at first and at most; sets that one set is verified against at a time.
FIRST_PAIRS = 1 << 12
MOST_PAIRS = 1 << 18
SLICE = 512


def plain_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the unpadded shingles: n - SHINGLE + 1 of n words, one of fewer, none of none."""
    hashes, bounds = minhash.shingle_hashes([t.translate(_LOWER) for t in texts], SHINGLE)
    words = np.diff(bounds)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], words)
    keep = place >= np.repeat(np.minimum(words, SHINGLE) - 1, words)
    return hashes[keep], np.r_[0, np.cumsum(np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0))]


#: (shingles of texts, how many at the start of a later piece of a long text belong to the one before).
PLAIN = (plain_shingles, 0)
PADDED = (minhash.shingle_hashes, SHINGLE - 1)


def shingle_sets(texts: list[bytes], kind: tuple = PLAIN) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, some megabytes of text at a time."""
    for part in minhash.chunks(texts):
        yield from minhash.shingle_sets(part, *kind)


def alike_groups(sets: list[np.ndarray], least: float = MIN_JACCARD, cells: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of the first of its group, by links of similarity ``least`` or more inside a cell."""
    cells = np.zeros(len(sets), np.int64) if cells is None else cells
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, cells))  # what follows works on places in this order
    cell, size = cells[order], sizes[order]
    end = np.searchsorted(cell, cell, side="right")
    group = np.arange(len(sets))
    bare = np.flatnonzero(size == 0)
    group = _merge(group, order[np.searchsorted(cell, cell[bare])], order[bare])
    _, word = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    edge = np.r_[0, np.cumsum(size)]
    here = np.zeros(len(word) + 1, np.int32)

    def verify(p: int, others: np.ndarray) -> None:
        """Join the group of the set at place ``p`` with those of the places among ``others`` whose sets are alike."""
        nonlocal group
        others = others[group[order[others]] != group[order[p]]]
        if not len(others):
            return
        own, many = word[edge[p] : edge[p + 1]], size[others]
        begins = np.r_[0, np.cumsum(many)]
        here[own] = 1
        common = np.add.reduceat(here[word[np.repeat(edge[others] - begins[:-1], many) + np.arange(begins[-1])]], begins[:-1])
        here[own] = 0
        near = others[common + 1e-9 >= least * (size[p] + many - common)]
        group = _merge(group, np.repeat(order[p], len(near)), order[near])

    def verify_pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        by_first = np.argsort(a, kind="stable")
        a, b = a[by_first], b[by_first]
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for p, others in zip(a[cuts].tolist(), np.split(b, cuts[1:]), strict=True):
            for at in range(0, len(others), SLICE):
                verify(p, others[at : at + SLICE])

    large = np.flatnonzero(size >= SMALL)
    fps = np.array([simhash.majority_bits(sets[order[p]]) for p in large], np.uint64)
    # verified as they are found: pairs that a link has joined by then are not asked for
    held, count, most = [], 0, FIRST_PAIRS
    for i, j in simhash.near_pairs(cell[large], fps, RADIUS, lambda a, b: (size[large[a]] + 1e-9 >= least * size[large[b]]) & (group[order[large[a]]] != group[order[large[b]]])):
        held.append((large[i], large[j]))
        count += len(i)
        if count >= most:
            verify_pairs(held)
            held, count, most = [], 0, min(2 * most, MOST_PAIRS)
    if held:
        verify_pairs(held)
    for p in np.flatnonzero((size > 0) & (size < SMALL)).tolist():  # all that are not too large to be alike
        last = p + 1 + int(np.searchsorted(size[p + 1 : end[p]], size[p] / least + 1e-9, side="right"))
        for at in range(p + 1, last, SLICE):
            verify(p, np.arange(at, min(at + SLICE, last)))
    return group


def _link_cells(kind: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows (cell, node, text) sorted by cell: a link from each node to the first of its group; small cells go side by side."""
        cells: list[int] = []
        nodes: list[int] = []
        sets: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            group = alike_groups(sets, cells=np.array(cells, np.int64)) if sets else np.zeros(0, np.int64)
            moved = np.flatnonzero(group != np.arange(len(group)))
            named = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(named[group[moved]]), pa.array(named[moved])], names=["a", "b"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for cell, node, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(texts, kind), strict=True):
                if cells and cell != cells[-1] and len(cells) >= CELL:
                    yield links()
                    cells, nodes, sets = [], [], []
                if not nodes or nodes[-1] != node or cells[-1] != cell:  # repeated rows of one doc_id
                    cells.append(cell)
                    nodes.append(node)
                    sets.append(found)
        if len(nodes) > 1:
            yield links()

    return run


def _band_keys(kind: tuple):
    @F.arrow_udf(ArrayType(LongType()))
    def run(text: pa.Array) -> pa.Array:
        found = minhash.signatures(text.cast(pa.binary()).to_pylist(), *kind)
        return pa.array(list(minhash.band_keys(found).view(np.int64)), pa.list_(pa.int64()))

    return run


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _cells(roots: DataFrame, shared: DataFrame, cell: int) -> DataFrame:
    """(cell, node): where each node is compared."""
    sized = roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")), "root")
    large = materialise(sized.filter(F.col("_n") > cell).select("node"), "large")  # read by what is returned
    small = sized.filter(F.col("_n") <= cell).select(F.col("root").alias("cell"), "node")
    if large.isEmpty():
        return small
    chunks = F.ceil(F.col("n") / cell * 2).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = F.when(F.col("n") <= cell, F.array(F.xxhash64("band"))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("band", F.least(j, own), F.greatest(j, own)))
    )
    return small.union(shared.join(large, "node", "left_semi").select(F.explode(dealt).alias("cell"), "node").distinct())


def classes(docs: DataFrame, kind: tuple = PLAIN, cell: int = CELL) -> DataFrame:
    """(doc_id, node, class_id) of each row: the hash of its text, and the smallest doc_id reachable by near copies."""
    named = docs.select("doc_id", _text().alias("text"))
    marked = materialise(named.select("doc_id", F.xxhash64("text").alias("node"), _band_keys(kind)(F.col("text")).alias("keys")), "marked")
    # equal texts are one node
    first = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")), "nodes")
    rows = materialise(marked.select("doc_id", "node"), "rows")
    remove_table(marked)
    bands = materialise(first.select("node", F.explode("keys").alias("band")), "bands")
    centres = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(bands.join(centres, "band"), "shared")
    remove_table(bands)
    roots = connected_components(shared.select("a", F.col("node").alias("b")))
    wanted = materialise(_cells(roots, shared, cell).join(first.select("node", F.col("least").alias("doc_id")), "node"), "wanted")
    # by shuffle at every size, as in keep_least
    read = named.join(wanted.filter("doc_id IS NOT NULL").hint("merge"), "doc_id").filter(F.xxhash64("text") == F.col("node")).select("cell", "node", "text")
    nameless = wanted.filter("doc_id IS NULL").select("cell", "node")
    if not nameless.isEmpty():
        own = named.filter("doc_id IS NULL").select(F.xxhash64("text").alias("node"), "text").dropDuplicates(["node"])
        read = read.union(own.join(nameless, "node").select("cell", "node", "text"))
    links = materialise(read.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_link_cells(kind), "a long, b long"), "links")
    remove_table(shared)
    remove_table(wanted)
    groups = connected_components(links)
    remove_table(links)
    rooted = first.join(groups, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.join(rooted.join(ids, "root").select("node", "class_id"), "node").select("doc_id", "node", "class_id")


def near_copies(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, component_id) for each row with a doc_id; component_id is the smallest doc_id reachable by near copies."""
    return classes(docs.filter(F.col("doc_id").isNotNull()), PLAIN, cell).select("doc_id", F.col("class_id").alias("component_id"))


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row: the classes of operator 10, over the shingles of its signatures."""
    return classes(docs, PADDED).select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies: the one with its smallest doc_id; rows without a doc_id stay."""
    return keep_least(docs, near_copies(docs))
