"""SimHash near-dedup: segment popcounts, a grid join under Manhattan distance, exact check.

A fingerprint's 64 bits are cut into 32 segments of 2 bits; the vector of their bit counts is an
embedding whose Manhattan distance never exceeds the Hamming distance.  The 32 segments form 8
slabs of 4.  Two fingerprints at most 4 apart differ in at most 4 slabs, so they agree on the bit
counts of 4 slabs at least: they share one of the C(8,4) = 70 grid cells (slab choice, counts
there).  Within a cell the Manhattan distance of the whole embedding screens, and the Hamming
distance decides.

Scale: a fingerprint is expanded into 70 narrow rows, once for each *distinct* fingerprint, so a
group of copies costs one.  A cell is streamed, sorted, through one task; up to ``CELL`` members
are compared block by block and only a spanning forest of their links is emitted.  The members of
larger cells take an exact way whose cost is linear in them: two fingerprints are at most 4 apart
if and only if some 64-bit value is at most 2 from both, so each emits the 2081 values around it
and is linked to the smallest one that emits the same value.  Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, any_names, drop_table, join_split, parallelism, tidy, write_table
from .components import connected_components
from .shingles import fingerprint_of, shingle_hashes
from .similar import SIMILARITY, one_of_each, similar_groups, text_key

RADIUS = 4
SLABS = 8
CELL = 16_384
SMALL = 16
SHINGLE = 4
_EVEN = 0x5555555555555555


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint) for every row of ``docs``.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; shingles of ``shingle`` words, repeats
    included, joined by one space (fewer words: all of them; no word or a null text: 0).  A bit is 1
    if it is set in over half the shingles' XXH64 (seed 42).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, fp bigint"
    )


def _counts(fp: np.ndarray) -> np.ndarray:
    """The 32 bit counts of 2-bit segments, each in 2 bits of a word."""
    return (fp & np.uint64(_EVEN)) + ((fp >> np.uint64(1)) & np.uint64(_EVEN))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two packed count vectors of values 0, 1, 2."""
    even, one = np.uint64(_EVEN), np.uint64(1)
    x = a ^ b
    low, high = x & even, (x >> one) & even
    # 0-1: low.  0-2: high.  1-2: both bits differ, distance 1.
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def links_within(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links among distinct fingerprints of one cell."""
    n = len(fp)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts, block = _counts(fp), max(1, 2_000_000 // max(n, 1))
    joined = False
    for at in range(0, n, block):
        stop = min(n, at + block)
        near = _manhattan(counts[at:stop, None], counts[None, at:]) <= radius
        rows, cols = np.nonzero(near)
        keep = cols > rows
        rows, cols = rows[keep] + at, cols[keep] + at
        exact = np.bitwise_count(fp[rows] ^ fp[cols]) <= radius
        for i, j in zip(rows[exact].tolist(), cols[exact].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                joined = True
    if not joined:
        return fp[:0], fp[:0]
    root = np.fromiter((find(i) for i in range(n)), np.int64, n)
    child = np.nonzero(root != np.arange(n))[0]
    return fp[child], fp[root[child]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, cell_size: int = CELL) -> DataFrame:
    """(a, b) bigint: links among distinct fingerprints ``fp``, enough of them to connect all that
    are at most ``radius`` (<= 4) apart."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}, got {radius}")
    spark = fps.sparkSession
    choices = list(combinations(range(SLABS), SLABS - RADIUS))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([sum(0xFF << (8 * s) for s in c) for c in choices], np.uint64)
        salt = (np.arange(len(choices), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 8192):
                part = fp[at : at + 8192]
                key = (_counts(part)[:, None] & masks[None, :]) ^ salt[None, :]
                key *= np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part, len(choices)).view(np.int64))], names=["cell", "fp"]
                )

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Runs of equal keys in sorted batches, in pieces of over ``cell_size`` members at most one
        batch long; the key comes with each piece."""
        key, held = None, []
        for batch in batches:
            keys, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            fp = fp.view(np.uint64)
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            if key is not None and keys[0] != key:
                yield key, np.concatenate(held)
                held = []
            # Cells of one member are most of all: they are passed over at once.
            first, last = cuts[:-1], cuts[1:]
            key = int(keys[-1])
            if len(first) == 1:
                held.append(fp)
            else:
                yield int(keys[0]), np.concatenate([*held, fp[: last[0]]])
                runs = last[1:-1] - first[1:-1]
                for i in np.nonzero(runs > SMALL)[0] + 1:
                    yield int(keys[first[i]]), fp[first[i] : last[i]]
                # Cells of a few members are compared all at once, at each distance along the batch.
                small = np.zeros(len(keys), bool)
                small[first[1] : last[-2] if len(first) > 2 else first[1]] = np.repeat((runs > 1) & (runs <= SMALL), runs)
                for d in range(1, SMALL):
                    i = np.nonzero(small[:-d] & (keys[:-d] == keys[d:]))[0]
                    if not len(i):
                        break
                    i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
                    if len(i):
                        yield None, (fp[i + d], fp[i])
                held = [fp[first[-1] :]]
            if sum(map(len, held)) > cell_size:
                yield key, np.concatenate(held)
                held = [held[0][:1]]  # keeps the key open; what follows is of a large cell too
        if held:
            yield key, np.concatenate(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, out_a, out_b, size = None, [], [], 0
        for key, fp in groups(batches):
            if key is None:
                a, b = fp
            elif key == large or len(fp) > cell_size:  # marked by a = b, for the other way
                large, a, b = key, fp, fp
            elif len(fp) > 1:
                a, b = links_within(fp, radius)
            else:
                continue
            out_a.append(a)
            out_b.append(b)
            size += len(a)
            if size > 50_000:
                yield _edges(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, size = [], [], 0
        if size:
            yield _edges(np.concatenate(out_a), np.concatenate(out_b))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
        half = radius // 2 if radius % 2 == 0 else radius // 2 + 1
        flips = [np.zeros(1, np.uint64)] + [np.array([np.bitwise_or.reduce(bit[list(c)]) for c in combinations(range(64), k)], np.uint64) for k in range(1, half + 1)]
        flips = np.concatenate(flips)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 256):
                part = fp[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["cell", "fp"]
                )

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, first = None, None
        for batch in batches:
            keys, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
            lead = np.repeat(fp[starts], np.diff(np.append(starts, len(keys))))
            if open_key is not None and keys[0] == open_key:
                lead[: starts[1] if len(starts) > 1 else len(keys)] = first
            open_key, first = keys[-1], lead[-1]
            # The smallest of a key need not be at most `radius` from the rest only if radius is odd.
            ok = (lead != fp) & (np.bitwise_count((lead ^ fp).view(np.uint64)) <= radius)
            yield _edges(fp[ok].view(np.uint64), lead[ok].view(np.uint64))

    if radius % 2:
        raise ValueError("radius must be even")
    n = parallelism(spark)
    cells = fps.select("fp").mapInArrow(tidy(to_cells), "cell bigint, fp bigint")
    found = write_table(
        cells.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(tidy(compare), "a bigint, b bigint").distinct(), "simhash-links"
    )
    if not found.where("a = b").limit(1).count():
        return found
    hot = found.where("a = b").select(F.col("a").alias("fp")).distinct().mapInArrow(tidy(around), "cell bigint, fp bigint")
    more = hot.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(tidy(star), "a bigint, b bigint").distinct()
    return found.where("a <> b").unionByName(write_table(more, "simhash-links"))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint, component_id): one row for each row of ``docs``.

    Fingerprints at most ``radius`` bits apart are linked; component_id is the smallest doc_id that
    links reach.  Defined cases: null or wordless texts have fingerprint 0, linked like any other;
    repeated rows share a component; a null doc_id is never chosen unless its component has no
    other; an empty table gives none.
    """
    table = write_table(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = write_table(table.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, radius))  # (node, root), linked nodes only
    member = distinct.join(roots, distinct["fp"] == roots["node"]).select("root", "fp", "first")
    smallest = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = member.join(smallest, "root").select(F.col("fp").alias("key"), "least")
    labels = distinct.join(linked, distinct["fp"] == linked["key"], "left").select("fp", F.coalesce("least", "first").alias("component_id"), "n")
    labels = write_table(labels.withColumnRenamed("fp", "key"), "simhash-labels")
    total = labels.agg(F.sum("n")).first()[0] or 0
    return join_split(table, "fp", labels, "key", "n", total, F.xxhash64("doc_id"))


@any_names
def deduplicate(docs: DataFrame, radius: int = RADIUS, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` less every near copy: of each group the row with the smallest doc_id
    stays, and one of its repeats.  All columns stay, whatever their names.  Rows are told apart by
    doc_id and text, so that neither null nor shared doc_ids make one document of several."""
    keyed = docs.withColumn("__key", text_key(docs["text"]))
    texts = keyed.select(F.col("__key").alias("doc_id"), "text")
    table = write_table(fingerprints(texts, shingle).distinct(), "simhash-fingerprints")
    roots = connected_components(fingerprint_links(table.select("fp").distinct(), radius)).withColumnRenamed("root", "least")
    labels = table.join(roots, table["fp"] == roots["node"], "left").select(F.col("doc_id").alias("node"), F.coalesce("least", "fp").alias("root"))
    return one_of_each(keyed, labels)


@any_names
def deduplicate_near(docs: DataFrame, similarity: Fraction = SIMILARITY, shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less every near copy: of each group that links of ``similarity`` or more (Jaccard, of
    the sets of shingles) join, the row with the smallest doc_id stays, and one of its repeats.

    Fingerprints at most ``radius`` apart, found by the grid, are candidates, which the shingle sets decide; so
    are texts that the same way over wide fingerprints finds (see ``similar``), since 64 bits reach no similarity
    of 0.8.  Defined cases: null and wordless texts are alike; rows with a null doc_id are as good as others,
    though never chosen where their group has another; texts that share a doc_id are told apart by their text;
    an empty table gives none.
    """
    keyed = docs.withColumn("__key", text_key(docs["text"]))
    texts = keyed.select(F.col("__key").alias("key"), F.col("text").cast("string").alias("text")).where("key <> 0")
    return one_of_each(keyed, similar_groups(texts, similarity, shingle, lambda fps: fingerprint_links(fps, radius)))


__all__ = ["DOCUMENT_COLUMNS", "deduplicate", "deduplicate_near", "drop_table", "fingerprint_links", "fingerprints", "near_groups"]
