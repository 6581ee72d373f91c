"""Substring dedup with prefix-partitioned suffix trees, cut off at the window's depth.

Suffixes of a document start at each word.  A repeat counts from ``window`` words on, so a suffix
tree is only needed down to that depth, and its internal nodes there are the windows that occur
more than once.  Suffixes are split into groups by a prefix of variable length, so that a group's
tree fits in memory: a first pass counts suffixes by their first two words (in ``2**CELLS`` cells,
a table of bounded size); cells that exceed a group's share are split further by the whole window.
Within a group the nodes at the window's depth are found by sorting path labels, which are 64-bit
hashes of the windows (besides the prefix that the group has in common): labels of single words
would take several times the disk that a run may use.  So no tree is built deeper than the window,
and a longer maximal repeat is the run of its windows.  Of each node's leaves all but those of the
smallest doc_id are repeats.

Each task first merges the suffixes that it holds itself, so a window sends on those of its smallest
doc_id only, and the rest are marked where they are: a passage in a third of all documents costs a
task one row.  Texts meet their places by bucket of doc_id, in compressed blobs.
Suffixes travel as sorted columns of bytes (key, document, place), a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, tidy, write_table

WINDOW = 13
PREFIX = 2
CELLS = 14
#: Suffixes that a task holds at once before it sends them on.
BLOCK = 2_000_000
#: Bytes of texts that a task deals out at once.
TEXTS = 48_000_000
#: Suffixes in a group of prefixes and in a bucket of documents, at most but for a single huge one:
#: tables that outgrow the session's partitions get more groups and buckets, not larger ones.
GROUP, BUCKET = 4_000_000, 8_000_000
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _tools():
    """Functions for Python workers; they see only what they need."""
    import re

    find = re.compile(rb"[^\x20\x09-\x0D]+").findall

    def mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    class Words(dict):
        """Word -> 64-bit hash; forgets all when it gets large."""

        def __missing__(self, word: bytes) -> int:
            import xxhash

            if len(self) > 500_000:
                self.clear()
            h = self[word] = xxhash.xxh3_64_intdigest(word)
            return h

    table = Words()

    def hashes(text) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        words = find(text.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))

    def runs(h: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(_M1) + h[i : i + n]
        return mix(out)

    return find, hashes, runs


def _prefix_counts(docs: DataFrame, window: int) -> DataFrame:
    """(cell, n): suffixes by the cell of their first words; a row a cell and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hashes, runs = _tools()
        n = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                h = hashes(text.as_py())
                if len(h) >= window:
                    cells = runs(h, PREFIX)[: len(h) - window + 1] >> np.uint64(64 - CELLS)
                    n += np.bincount(cells.astype(np.int64), minlength=1 << CELLS)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    return docs.select("text").mapInArrow(tidy(run), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _plan(counts: list[tuple[int, int]], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """first group and number of groups of each cell: cells in order, a share of suffixes each; a
    cell of more than a share gets several groups, dealt by a longer prefix, the window."""
    n = np.zeros(1 << CELLS, np.int64)
    for cell, k in counts:
        n[cell] = k
    share = max(1, -(-int(n.sum()) // groups))
    first, span = np.zeros(1 << CELLS, np.int32), np.ones(1 << CELLS, np.int32)
    group, held = 0, 0
    for cell in np.nonzero(n)[0]:
        if held and held + n[cell] > share:
            group, held = group + 1, 0
        first[cell], span[cell] = group, max(1, -(-int(n[cell]) // share))
        if span[cell] > 1:
            group, held = group + span[cell], 0
        else:
            held += n[cell]
    return first, span


def _pack(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """A sorted key column as differences, all columns as byte planes, compressed."""
    import zstandard

    planes = [np.diff(keys, prepend=np.uint64(0)), *others]
    raw = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() for p in planes)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, n: int, *types: type) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 0
    for dtype in (np.uint64, *types):
        w = np.dtype(dtype).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(dtype).ravel())
        at += n * w
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _pack_places(doc: np.ndarray, place: np.ndarray) -> bytes:
    """(document, word) pairs, sorted, each once; places as steps."""
    by = np.lexsort((place, doc.view(np.uint64)))
    doc, place = doc.view(np.uint64)[by], place[by].astype(np.uint32)
    return _pack(doc, np.diff(place, prepend=np.uint32(0)).astype(np.uint32))


def _unpack_places(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    doc, step = _unpack(blob, n, np.uint32)
    return doc.view(np.int64), np.cumsum(step, dtype=np.uint32)


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64) * np.uint64(_M1)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _narrow(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.where("doc_id is not null and text is not null")


def _layout(docs: DataFrame, window: int) -> tuple[list[tuple[int, int]], int, int]:
    """(counts by prefix cell, groups, buckets)."""
    n = parallelism(docs.sparkSession)
    counts = [(r[0], r[1]) for r in _prefix_counts(_narrow(docs), window).collect()]  # 2**CELLS rows at most
    total = sum(k for _, k in counts)
    return counts, max(4 * n, -(-total // GROUP)), max(n, -(-total // BUCKET))


def repeated_windows(docs: DataFrame, window: int = WINDOW, layout: tuple | None = None) -> DataFrame:
    """(bucket, n, blob): packed pairs (doc_id, word) of all places where a window of ``window`` words
    starts whose words also start in a document with a smaller doc_id; a document's pairs are in the
    bucket of its doc_id, in one or more rows.  :func:`_unpack_places` reads them.

    Rows of one doc_id are taken as one text's repeats: none is smaller than the other.  Rows with a
    null doc_id neither have nor cause repeats.
    """
    docs = _narrow(docs)
    counts, groups, buckets = layout or _layout(docs, window)
    first, span = _plan(counts, groups)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hashes, runs = _tools()

        def row(*values) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["grp", "n", "docs", "blob"])

        def send(ids: list, parts: list) -> Iterator[pa.RecordBatch]:
            """A block of documents, ascending in ``ids``: keys, prefixes, document numbers, places."""
            order = np.argsort(np.array(ids), kind="stable")
            ids = np.array(ids, np.int64)[order]
            # Equal ids are one document.
            number = np.cumsum(np.concatenate([[0], np.diff(ids) != 0])).astype(np.uint32)
            unique = ids[np.concatenate([[True], np.diff(ids) != 0])]
            key = np.concatenate([parts[i][0] for i in order])
            cell = np.concatenate([parts[i][1] for i in order])
            sizes = [len(parts[i][0]) for i in order]
            doc = np.repeat(number, sizes)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
            by = np.argsort(key, kind="stable")  # within a key ascending documents
            key, cell, doc, place = key[by], cell[by], doc[by], place[by]
            start = np.concatenate([[True], key[1:] != key[:-1]])
            least = doc[np.nonzero(start)[0]][np.cumsum(start) - 1]
            later = doc != least
            # What repeats an earlier document of this block is marked here.
            if later.any():
                d, p = unique[doc[later]], place[later]
                yield row(-1, len(d), None, _pack_places(d, p))
                keep = ~later
                key, cell, doc, place = key[keep], cell[keep], doc[keep], place[keep]
            group = first[cell] + (mix32(key) % span[cell].astype(np.uint32)).astype(np.int32)
            by = np.argsort(group, kind="stable")
            key, doc, place, group = key[by], doc[by], place[by], group[by]
            cut = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                used, local = np.unique(doc[a:b], return_inverse=True)
                yield row(int(group[a]), int(b - a), unique[used].tobytes(), _pack(key[a:b], local.astype(np.uint32), place[a:b]))

        def mix32(x: np.ndarray) -> np.ndarray:
            return ((x * np.uint64(_M2)) >> np.uint64(32)).astype(np.uint32)

        ids, parts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = hashes(text.as_py())
                if len(h) < window:
                    continue
                key = runs(h, window)
                ids.append(doc_id)
                parts.append((key, (runs(h, PREFIX)[: len(key)] >> np.uint64(64 - CELLS)).astype(np.int32)))
                held += len(key)
                if held >= BLOCK:
                    yield from send(ids, parts)
                    ids, parts, held = [], [], 0
        if ids:
            yield from send(ids, parts)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeats(blobs: list) -> tuple[np.ndarray, np.ndarray]:
            """The leaves, but the smallest document's, of a group's nodes with several documents."""
            keys, docs_, places = [], [], []
            for n, table, blob in blobs:
                k, d, p = _unpack(blob, n, np.uint32, np.uint32)
                keys.append(k)
                docs_.append(np.frombuffer(table, np.int64)[d])
                places.append(p)
            key, doc, place = (np.concatenate(x) for x in (keys, docs_, places))
            del keys, docs_, places
            by = np.argsort(key, kind="stable")
            key = key[by]
            start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            size = np.diff(np.append(start, len(key)))
            many = np.repeat(size > 1, size)
            key, doc, place = key[many], doc[by][many], place[by][many]
            start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
            least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(key)))) if len(key) else doc
            later = doc > least
            return doc[later], place[later]

        def deal(found: list) -> Iterator[pa.RecordBatch]:
            doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            to = _bucket(doc, buckets)
            by = np.argsort(to, kind="stable")
            doc, place, to = doc[by], place[by], to[by]
            cut = np.concatenate([[0], np.nonzero(np.diff(to))[0] + 1, [len(to)]])
            rows = [(int(to[a]), int(b - a), _pack_places(doc[a:b], place[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "blob"])

        group, blobs, found, held = None, [], [], 0
        for batch in batches:
            for g, n, table, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group and len(blobs) > 1:  # a lone block has settled its own
                    found.append(repeats(blobs))
                    held += len(found[-1][0])
                if g != group:
                    group, blobs = g, []
                if table is None:
                    found.append(_unpack_places(blob, n))
                    held += n
                else:
                    blobs.append((n, table, blob))
                if held > BLOCK:
                    yield from deal(found)
                    found, held = [], 0
        if len(blobs) > 1:
            found.append(repeats(blobs))
        if found:
            yield from deal(found)

    sent = docs.mapInArrow(tidy(split), "grp int, n bigint, docs binary, blob binary")
    # What blocks settled themselves goes anywhere.
    key = F.when(F.col("grp") >= 0, F.col("grp")).otherwise(F.crc32("blob"))
    dealt = sent.withColumn("deal", key).repartition(buckets, "deal").sortWithinPartitions("grp").drop("deal")
    return dealt.mapInArrow(tidy(trees), "bucket int, n bigint, blob binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): for each row of ``docs`` its words that no repeated window
    covers, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged; windows are judged on the input.  Defined cases: a
    null text has no words; rows with a null doc_id keep all; equal rows get equal results.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = _layout(docs, window)
    buckets = layout[2]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket of their doc_id, many to a compressed blob."""
        import zstandard

        def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            to = _bucket(np.asarray(batch.column(0).fill_null(0)), buckets)
            for b in np.unique(to):
                part = batch.take(pa.array(np.nonzero(to == b)[0]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([-1], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "n", "blob"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > TEXTS:
                yield from send(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size = [], 0
        if size or any(b.num_rows for b in held):
            yield from send(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a bucket places come first (n > 0), then texts (n = -1)."""
        import re

        import zstandard

        find = re.compile(r"[^\x20\x09-\x0D]+").findall
        bucket, docs_, places = None, [], []

        def cut(doc_id, text, doc, place) -> tuple:
            words = find(text or "")
            n = len(words)
            if doc_id is not None and n >= window:
                at = np.unique(place[np.searchsorted(doc, doc_id, "left") : np.searchsorted(doc, doc_id, "right")]).astype(np.int64)
                at = at[at <= n - window]
                if len(at):
                    cover = np.zeros(n + 1, np.int32)
                    cover[at] += 1
                    cover[at + window] -= 1
                    out = np.cumsum(cover[:n]) > 0
                    return doc_id, n, int(out.sum()), " ".join([words[i] for i in np.nonzero(~out)[0]])
            return doc_id, n, 0, " ".join(words)

        for batch in batches:
            for b, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    bucket, docs_, places, ready = b, [], [], False
                if n >= 0:
                    d, p = _unpack_places(blob, n)
                    docs_.append(d)
                    places.append(p)
                    continue
                if not ready:
                    doc = np.concatenate([*docs_, np.zeros(0, np.int64)])
                    place = np.concatenate([*places, np.zeros(0, np.uint32)])
                    by = np.argsort(doc, kind="stable")
                    doc, place, docs_, places, ready = doc[by], place[by], [], [], True
                for part in pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)):
                    for at in range(0, part.num_rows, 1000):
                        piece = part.slice(at, 1000)
                        rows = [cut(i, t.as_py(), doc, place) for i, t in zip(piece.column(0).to_pylist(), piece.column(1), strict=True)]
                        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    marks = write_table(repeated_windows(docs, window, layout), "substring-places")
    texts = docs.mapInArrow(tidy(deal), "bucket int, n bigint, blob binary")
    rows = marks.unionByName(texts).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("n").desc())
    return rows.mapInArrow(tidy(apply), "doc_id bigint, n_words bigint, n_removed bigint, kept string")
