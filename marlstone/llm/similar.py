"""Near-dedup by Jaccard similarity of word shingles: wide fingerprints, segment popcounts, exact check.

A SimHash of 64 bits can't decide a similarity of 0.8 (such pairs lie some 10 bits apart, many over
14), and no radius of its grid reaches there; so its links are only the first candidates.  A text's
wide fingerprint is the bitmap of its distinct 64-bit shingle hashes; the Hamming distance of two is
the size of their symmetric difference, which the similarity bounds.

1. Cells.  All hashes stand in one order that all texts share (hashes that a bounded sample shows to
   be common last; the order bears on speed alone).  Two sets of similarity t or more have a hash in
   common among the first ``n - ceil(t n) + 1`` of each, so texts that share such a cell are
   candidates, and no others can be similar.
2. Segment popcounts.  A bitmap's segments are counted (segments by the leading bits, about four
   hashes each), and the Manhattan distance of two vectors of counts never exceeds the Hamming
   distance: candidates whose distance is over what the similarity allows are passed over, without
   loss.  Within a cell the parities of 1,024 bins screen first, for the same reason.
3. The shingle sets of what is left decide.

Scale: only (hash, text key) rows travel, and those of hashes held once go no further.  Each text is
first checked against the smallest key of its cells; afterwards only members of different groups are
compared, so a large group of near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, parallelism, tidy, write_table
from .components import connected_components
from .shingles import fingerprint_of, shingle_hashes

SIMILARITY = Fraction(4, 5)
SHINGLE = 5
SKETCH = 1024
#: Texts that the order of hashes is taken from, at most, and how many of them make a hash common.
SAMPLE, COMMON = 4_096, 6


def text_key(text: Column) -> Column:
    """64 bits that tell texts apart; null and wordless texts have 0."""
    text = text.cast("string")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def segment_counts(h: np.ndarray) -> np.ndarray:
    """The popcounts (uint8) of a bitmap's segments: a power of two of them, about one for four of the distinct,
    sorted hashes.  Where a segment's count is over a byte: empty, which screens nothing."""
    bits = max(4, min(16, (max(1, len(h)) - 1).bit_length() - 2))
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else np.zeros(0, np.uint8)


def manhattan(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two vectors of segment counts; the finer one is folded to the other's segments."""
    n = min(len(a), len(b))
    if not n:
        return 0
    x, y = (v.reshape(n, -1).sum(axis=1, dtype=np.int32) for v in (a, b))
    return int(np.abs(x - y).sum())


def _similar(common, n_a, n_b, t: Fraction):
    """Whether ``common`` of sets of ``n_a`` and ``n_b`` make a similarity of ``t``: in integers."""
    return common * (t.numerator + t.denominator) >= t.numerator * (n_a + n_b)


def _possible(differ, n_a, n_b, t: Fraction):
    """Whether sets with at least ``differ`` members in one alone can have a similarity of ``t``."""
    fits = differ * (t.numerator + t.denominator) <= (t.denominator - t.numerator) * (n_a + n_b)
    return fits & (np.minimum(n_a, n_b) * t.denominator >= np.maximum(n_a, n_b) * t.numerator)


def common_hashes(texts: DataFrame, shingle: int) -> np.ndarray:
    """Hashes held by ``COMMON`` texts or more of a sample of ``SAMPLE`` (those with the smallest hash of their
    key): sorted, a few thousand at most.  They bear on the order of cells alone, not on results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["hash"])

    picked = texts.select(F.col("key").alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    some = texts.join(F.broadcast(picked), texts["key"] == picked["k"]).dropDuplicates(["key"]).select("text")
    counts = some.mapInArrow(tidy(run), "hash bigint").groupBy("hash").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "hash").limit(4 * SAMPLE).collect()
    return np.sort(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))


def profiles(texts: DataFrame, t: Fraction, shingle: int, common: np.ndarray) -> DataFrame:
    """(key, n, fp, sketch, counts, prefix) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ns, fps, sketches, counts, prefixes = [], [], [], [], []
                for text in part.column(1):
                    h = shingle_hashes(text.as_py(), shingle)
                    fps.append(fingerprint_of(h))
                    h = np.unique(h)
                    n = len(h)
                    bins = np.bincount((h >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
                    ns.append(n)
                    sketches.append(np.packbits(bins.astype(np.uint8)).tobytes())
                    counts.append(segment_counts(h).tobytes())
                    if len(common):
                        last = np.isin(h, common, assume_unique=True)
                        h = np.concatenate([h[~last], h[last]])
                    prefixes.append(h[: n + (-n * t.numerator // t.denominator) + 1 if n else 0].view(np.int64))
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(flat, pa.int64()))
                columns = [part.column(0), pa.array(ns, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(counts, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "fp", "sketch", "counts", "prefix"])

    return texts.mapInArrow(tidy(run), "key bigint, n bigint, fp bigint, sketch binary, counts binary, prefix array<bigint>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, key, lead) of hashes that several keys hold, from sorted (hash, key); lead: the smallest."""
    last_h = last_k = lead = None
    for batch in batches:
        h, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[0] = last_h is None or h[0] != last_h
        fresh = new.copy()
        fresh[1:] |= k[1:] != k[:-1]
        fresh[0] |= last_k is None or k[0] != last_k
        starts = np.nonzero(new)[0]
        leads = np.empty(len(h), np.int64)
        first = starts[0] if len(starts) else len(h)
        leads[:first] = lead if lead is not None else 0
        leads[first:] = np.repeat(k[starts], np.diff(np.append(starts, len(h))))
        out = fresh & (k != leads)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(k[out]), pa.array(leads[out])], names=["hash", "key", "lead"])
        last_h, last_k, lead = h[-1], k[-1], leads[-1]


def _across(t: Fraction):
    """Pairs (a, b) of different groups in a hash's run that may be similar, from rows (hash, key,
    root, n, sketch) sorted by hash."""

    def pairs_of(key, root, n, sketch):
        if len(key) < 2 or (root == root[0]).all():
            return
        block = max(1, 100_000 // len(key))
        for at in range(0, len(key), block):
            stop = min(len(key), at + block)
            i, j = np.nonzero((root[at:stop, None] != root[None, :]) & _possible(0, n[at:stop, None], n[None, :], t))
            i, j = i[j > i + at] + at, j[j > i + at]
            for part in range(0, len(i), 100_000):
                a, b = i[part : part + 100_000], j[part : part + 100_000]
                ok = _possible(np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64), n[a], n[b], t)
                if ok.any():
                    x, y = key[a[ok]], key[b[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, key, root, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            cuts = np.concatenate([[0], np.nonzero(np.diff(h))[0] + 1, [len(h)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if h[a] != current:
                    if held:
                        yield from pairs_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, current = [], h[a]
                held.append((key[a:b], root[a:b], n[a:b], sketch[a:b]))
        if held:
            yield from pairs_of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _screened(pairs: DataFrame, table: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes, parities and segment counts allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                s = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for i in (4, 5)]
                ok = _possible(np.bitwise_count(s[0] ^ s[1]).sum(axis=1, dtype=np.int64), n_a, n_b, t)
                for i in np.nonzero(ok)[0].tolist():
                    x, y = (np.frombuffer(part.column(c)[i].as_py(), np.uint8) for c in (6, 7))
                    ok[i] = _possible(manhattan(x, y), n_a[i], n_b[i], t)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    sides = [table.select(F.col("key").alias(f"k{s}"), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("counts").alias(f"c{s}")) for s in "ab"]
    both = pairs.join(sides[0], pairs["a"] == sides[0]["ka"]).join(sides[1], F.col("b") == F.col("kb"))
    return both.select("a", "b", "na", "nb", "sa", "sb", "ca", "cb").mapInArrow(tidy(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, t: Fraction, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity; each text's set is computed once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                held = [shingle_set(x.as_py(), shingle).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.binary())], names=["key", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(bool(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    some = texts.join(wanted, texts["key"] == wanted["w"], "left_semi").dropDuplicates(["key"])
    some = write_table(some.mapInArrow(tidy(sets), "key bigint, held binary"), "similar-sets")
    sides = [some.select(F.col("key").alias(f"k{s}"), F.col("held").alias(f"h{s}")) for s in "ab"]
    both = pairs.join(sides[0], pairs["a"] == sides[0]["ka"]).join(sides[1], F.col("b") == F.col("kb"))
    out = write_table(both.select("a", "b", "ha", "hb").mapInArrow(tidy(run), "a bigint, b bigint"), "similar-links")
    drop_table(some)
    return out


def similar_groups(texts: DataFrame, similarity: Fraction = SIMILARITY, shingle: int = SHINGLE, near: Callable | None = None) -> DataFrame:
    """(node, root) for the keys of ``texts`` (key, text) that are linked to others: two are linked
    if the Jaccard similarity of their sets of shingles is ``similarity`` or more.

    ``near``: a function from fingerprints (fp) to links (a, b) among them, whose texts are candidates too.
    """
    n = parallelism(texts.sparkSession)
    table = write_table(profiles(texts, similarity, shingle, common_hashes(texts, shingle)), "similar-profiles")
    rows = table.select(F.explode("prefix").alias("hash"), "key")
    shared = write_table(
        rows.repartition(n, "hash").sortWithinPartitions("hash", "key").mapInArrow(tidy(_shared), "hash bigint, key bigint, lead bigint"), "similar-shared"
    )
    first = shared.select(F.col("key").alias("a"), F.col("lead").alias("b"))
    if near:
        lead = write_table(table.groupBy("fp").agg(F.min("key").alias("lead")), "similar-fingerprints")
        named = [lead.select(F.col("fp").alias(f"fp{s}"), F.col("lead").alias(f"lead{s}")) for s in "ab"]
        links = near(lead.select("fp"))
        links = links.join(named[0], links["a"] == F.col("fpa")).join(named[1], links["b"] == F.col("fpb")).select(F.col("leada").alias("a"), F.col("leadb").alias("b"))
        alike = table.join(named[0], table["fp"] == F.col("fpa")).select(F.col("key").alias("a"), F.col("leada").alias("b")).where("a <> b")
        first = first.unionByName(links.unionByName(alike).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    table = table.select("key", "n", "sketch", "counts").dropDuplicates(["key"])
    first = write_table(_screened(first.distinct(), table, similarity), "similar-pairs")
    links = _verified(first, texts, similarity, shingle)
    roots = connected_components(links)
    # What stays apart is compared across groups.
    holders = shared.select("hash", "key").unionByName(shared.select("hash", F.col("lead").alias("key")).distinct())
    named = holders.join(roots, holders["key"] == roots["node"], "left").select("hash", "key", F.coalesce("root", "key").alias("root"))
    named = write_table(named, "similar-named")
    mixed = named.groupBy(F.col("hash").alias("h")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    named = named.join(mixed, named["hash"] == mixed["h"], "left_semi").join(table.drop("counts"), "key").select("hash", "key", "root", "n", "sketch")
    across = named.repartition(n, "hash").sortWithinPartitions("hash", "key").mapInArrow(tidy(_across(similarity)), "a bigint, b bigint")
    second = write_table(_screened(across.distinct().join(first, ["a", "b"], "left_anti"), table, similarity), "similar-pairs")
    more = _verified(second, texts, similarity, shingle)
    return connected_components(links.unionByName(more))


def one_of_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but one of each group: the smallest doc_id stays (a null one only
    where there is no other) and one of its repeats.  ``docs`` has ``__key``; labels: (node, root)."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("__key").alias("key")).distinct()
    named = ids.join(labels, ids["key"] == labels["node"], "left").select("id", "key", F.coalesce("root", "key").alias("root"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    best = write_table(best.select(F.col("best.id").alias("__id"), F.col("best.key").alias("__best")), "near-keep")
    kept = docs.join(best, (docs["__key"] == best["__best"]) & docs["doc_id"].cast("bigint").eqNullSafe(best["__id"])).drop("__id", "__best")
    rows = kept.groupBy(F.col("doc_id").cast("bigint").alias("__id"), F.col("__key").alias("__same")).count().where("count > 1").drop("count")
    rows = write_table(rows, "near-repeats")
    if not rows.limit(1).count():
        return kept.drop("__key")
    same = (kept["__key"] == rows["__same"]) & kept["doc_id"].cast("bigint").eqNullSafe(rows["__id"])
    repeated = kept.join(rows, same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return kept.join(rows, same, "left_anti").unionByName(repeated).drop("__key")
