"""Best-fit packing of token sequences by the linear grouping scheme.

Only the number of pieces of each length matters to a packing, and there are at most ``capacity``
lengths: that histogram, of bounded size, is what the driver solves.  Pieces longer than
``capacity // SMALL`` are large: sorted by length they fall into ``GROUPS`` groups of equal
cardinality, each rounded up to its longest.  Configurations of the few rounded sizes are optimised
by column generation (a linear programme with a knapsack for its columns) and rounded down; actual
pieces take the places of their group, longest first; what is left and the small pieces are then
best-fit, longest first, into the space that the actual pieces leave.  Runs of equal sequences are
one entry throughout, so the work doesn't grow with the number of documents.

A piece finds its place by its length and its rank among pieces of that length.  Ranks come from
counts of (task, length) and so need neither a global sort nor one task for a common length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import constant_array, count_below, tidy, write_table

CAPACITY = 2048
SMALL = 8
GROUPS = 64
#: Columns generated at most; each intermediate programme is feasible, so a limit costs quality only.
ROUNDS = 300
#: Strings whose tokens a worker remembers, in each of two generations.
MEMO = 300_000


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    """A function from text to its token ids as bytes, kept by a worker for its next task: what it remembers of
    words is bounded by ``MEMO``."""
    import re
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    find = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall

    class Memo(dict):
        """Two generations: what is asked for again outlives the rest."""

        def __init__(self, make) -> None:
            self.make, self.old = make, {}

        def __missing__(self, word: str) -> bytes:
            if len(self) > MEMO:
                self.old = dict(self)
                self.clear()
            out = self.old.get(word)
            if out is None:
                out = self.make(word)
            self[word] = out
            return out

    def encode(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    # Of ASCII and the letters of Latin-1 alone, in lower case, a text's pre-tokens are found here as the
    # tokenizer would find them, and each distinct one goes to the model, its bytes as printable characters.
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    other = re.compile("|".join(["[^\\t\\n\\r -~À-ÖØ-öø-ÿ]", *added])).search
    parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+").findall
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    shown = {b: chr(256 + i) for i, b in enumerate(hidden)}
    tokenize = tokenizer.model.tokenize

    def part(text: str) -> bytes:
        plain = text if text.isascii() else text.encode().decode("latin-1").translate(shown)
        return array("I", [t.id for t in tokenize(plain)]).tobytes()

    tokens, chunks = Memo(part), Memo(encode)

    def plain(text: str) -> bytes:
        return b"".join(map(tokens.__getitem__, parts(text.lower())))

    # The short ways hold for tokenizers that agree with them on a sample of forms: blanks that belong to no
    # token, and pre-tokens as above.  Others encode blank by blank, or whole texts.
    blanks = ["Two words", " a  b ", "line\nnext\r\n\ttab, end.\n", "\x0b1 2\x0c 3", "it's  12 <|endoftext|> é ü"]
    if any(b"".join(map(encode, find(x))) != encode(x) for x in blanks):
        return encode
    probes = ["Ab ABC.\n\tété, à (Über!?) straße; ÿÀÖØ: the nTh...", "It's WE'LL they're'd x'tc ''s 'S 12 3a4-5 a_b {c}=\"d\" e'f", "~`@#$%^&*|\\<> A1b2 éÉ'm"]
    short = all(not other(p) and plain(p) == encode(p) for p in probes)

    def whole(text: str) -> bytes:
        if short and not other(text):
            return plain(text)
        return b"".join([plain(x) if short and not other(x) else chunks[x] for x in find(text)])

    return whole


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, place): each row of ``docs`` as token ids (without
    special tokens, then ``end_id``), cut into pieces of ``capacity``; ``ids`` are little-endian
    unsigned 32-bit numbers.  A null text is empty: ``end_id`` alone.

    Where blanks always separate a tokenizer's tokens, texts are encoded blank by blank and each
    distinct string between blanks once; a sample of texts decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        names = ["doc_id", "piece", "start", "length", "ids", "task", "place"]
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    n = len(ids) // 4
                    rows.append((doc_id, piece, at // 4, n, ids, task, int(seen[n])))
                    seen[n] += 1
                    size += len(ids)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    table = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(tidy(run), "doc_id bigint, piece int, start bigint, length int, ids binary, task int, place bigint")


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of ``sizes`` within ``capacity`` that is worth most (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = np.nonzero(sizes <= c)[0]
        value = best[c - sizes[fit]] + worth[fit]
        i = int(value.argmax())
        if value[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = value[i], fit[i]
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        column[choice[c]] += 1
        c -= int(sizes[choice[c]])
    return column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(configuration, times): whole sequences of rounded sizes; never more of a size than demanded."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)  # duals: every column costs one sequence
        column = _best_column(sizes, np.maximum(worth, 0), capacity)
        if column @ worth <= 1 + 1e-7:
            break
        level, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.linalg.inv(basis) @ demand + 1e-9).astype(np.int64)
    out, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-times):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        n = min(int(times[j]), int((left[used] // column[used]).min())) if used.any() else 0
        if n > 0:
            out.append((column, n))
            left -= n * column
    assert m == len(left) and (left >= 0).all()
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Places for ``histogram`` (length -> pieces): rows (length, first rank, pieces, first sequence,
    offset), sorted, and the number of sequences.  Piece ``first rank + i`` of its length goes to
    sequence ``first sequence + i``."""
    taken = dict.fromkeys(histogram, 0)
    classes: list[tuple[int, tuple, int]] = []  # (sequences, contents as (length, first rank), space left)
    large = sorted((n for n in histogram if n > capacity // small), reverse=True)
    total = sum(histogram[n] for n in large)
    sizes, demand, member, count = [], [], [], 0
    for n in large:
        g = count * groups // max(total, 1)
        if not sizes or g != member[-1][0]:
            sizes.append(n)
            demand.append(0)
            member.append((g, []))
        demand[-1] += histogram[n]
        member[-1][1].append(n)
        count += histogram[n]

    def take(group: int, k: int) -> list[tuple[int, int, int]]:
        """The next k pieces of a group, longest first, as runs (length, first rank, pieces)."""
        out = []
        for n in member[group][1]:
            here = min(k, histogram[n] - taken[n])
            if here:
                out.append((n, taken[n], here))
                taken[n] += here
                k -= here
        assert not k
        return out

    if sizes:
        for column, times in configurations(np.array(sizes), np.array(demand, float), capacity):
            slots = [take(g, times) for g in np.nonzero(column)[0] for _ in range(column[g])]
            done, where = 0, [0] * len(slots)
            heads = [list(s[0]) for s in slots]
            while done < times:
                run = min(h[2] for h in heads)
                classes.append((run, tuple((h[0], h[1]) for h in heads), capacity - sum(h[0] for h in heads)))
                done += run
                for i, h in enumerate(heads):
                    h[1] += run
                    h[2] -= run
                    if not h[2] and done < times:
                        where[i] += 1
                        heads[i] = list(slots[i][where[i]])
    # Best fit of what is left, longest first.
    space: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    for n, contents, free in classes:
        space[free].append((n, contents))
    filled = np.array([len(s) > 0 for s in space])
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length] - taken[length], taken[length]
        while left:
            at = int(filled[length:].argmax()) + length if length <= capacity else capacity + 1
            if at > capacity or not filled[at]:
                fit = capacity // length
                n = left // fit or 1
                k = min(fit, left)
                contents = tuple((length, rank + i * n) for i in range(k))
                rank, left, at = rank + n * k, left - n * k, capacity - k * length
                space[at].append((n, contents))
                filled[at] = True
                continue
            n, contents = space[at].pop()
            filled[at] = bool(space[at])
            use = min(n, left)
            if use < n:
                space[at].append((n - use, tuple((c, r + use) for c, r in contents)))
                filled[at] = True
            space[at - length].append((use, (*contents, (length, rank))))
            filled[at - length] = True
            rank, left = rank + use, left - use
    rows, sequence = [], 0
    for bucket in space:
        for n, contents in bucket:
            offset = 0
            for length, rank in contents:
                rows.append((length, rank, n, sequence, offset))
                offset += length
            sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, sequence


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for each piece of :func:`pieces`.

    Sequences are numbered from 0 and filled without gaps from offset 0.  Repeated rows are packed
    as often as they occur; an empty table gives no sequence.
    """
    table = write_table(pieces(docs, tokenizer_path, capacity, end_id), "packing-pieces")
    counts = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = write_table(counts, "packing-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("task").alias("t"), F.col("length").alias("l"), F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    places, _ = plan(histogram, capacity)
    ranked = table.join(offsets, (table["task"] == offsets["t"]) & (table["length"] == offsets["l"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("place")).alias("rank"))
    # The last place at or before (length, rank), by binary search: ids stay where they are.
    lengths, firsts, sequences, starts = (constant_array(places[:, i].tolist(), "bigint") for i in (0, 1, 3, 4))

    def below(i: Column) -> Column:
        return (F.get(lengths, i) < F.col("length")) | ((F.get(lengths, i) == F.col("length")) & (F.get(firsts, i) <= F.col("rank")))

    ranked = ranked.withColumn("at", count_below(len(places), below) - 1)
    sequence = F.get(sequences, F.col("at")) + F.col("rank") - F.get(firsts, F.col("at"))
    return ranked.select("doc_id", "piece", "start", "length", "ids", sequence.alias("sequence_id"), F.get(starts, F.col("at")).alias("offset"))
