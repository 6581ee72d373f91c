"""Line dedup by pairwise alignment: rare shared lines, patience diff, common blocks deleted.

A document's *units* are its lines of ``LEAST_CHARS`` characters or more and, around shorter lines, the
shortest runs of lines that reach that length (forwards and backwards from each short line, blank
lines aside); a document too short for any is one unit as a whole.  So every unit is long enough to
tell of an overlap, and blocks of short lines are found like others.

A document is paired with the first holder of each unit that it shares: the earliest (doc_id, text)
that has it.  The pairs of a document are taken rarest line first.  Each is aligned by patience diff:
units that occur once in both, in their longest common order, and so on between them.  What the diff
leaves over because it crosses the alignment or repeats is aligned again, as moved blocks.  The
common blocks leave the later document.  Since moved blocks are aligned too, nothing that an earlier
document holds escapes for standing elsewhere in the first holder: aligning with any other holder
would add no line (a test compares with brute force over all pairs).  No count of holders switches
anything off.

Scale: a unit gives a document one partner, whoever else holds it, so pairs grow with lines, not
with the square of a group, and only narrow rows (hash, document, place) travel: no document's lines
are sent to a partner.  Units held by more than their share of all rows are joined by a broadcast
table of at most ``8 x partitions`` rows; the others have no hot key by definition.  Texts are
shuffled once, to what is to be cut from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import any_names, drop_table, parallelism, tidy, write_table

#: Characters that a unit has at least.
LEAST_CHARS = 20
#: Units of more than one in ``HOT x partitions`` rows are joined by broadcast.
HOT = 8
_BLANK = " \t\n\v\f\r"


def patience_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, lines) of a patience diff: equal ends first, then lines
    unique to both in their longest common order, and so on between them.  What has no unique line
    in common and no equal ends is different."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = None if a[i] in once else i
        there: dict = {}
        for j in range(b0, b1):
            there[b[j]] = None if b[j] in there else j
        both = [(j, once[x]) for x, j in there.items() if j is not None and once.get(x) is not None]
        if not both:
            continue
        both.sort()
        chain = _longest_rising(both)
        i0, j0 = a0, b0
        for j, i in chain:
            todo.append((i0, i, j0, j))
            pairs.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    pairs.sort()
    return _blocks(pairs)


def _blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    blocks: list[list[int]] = []
    for i, j in pairs:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (j, i), sorted by j, whose i rise."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for at, (_, i) in enumerate(pairs):
        pile = bisect_left(tops, i)
        back[at] = ends[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(i)
            ends.append(at)
        else:
            tops[pile], ends[pile] = i, at
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def _moved(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs (place in the later, place in the earlier), sorted, dealt to as few rising chains as there
    can be, each a move; the chains one after another."""
    tops: list[int] = []  # negated ends of the chains, rising: the chain with the greatest end below is found first
    chains: list[list[tuple[int, int]]] = []
    for j, i in pairs:
        at = bisect_left(tops, 1 - i)
        if at == len(tops):
            tops.append(-i)
            chains.append([(j, i)])
        else:
            tops[at] = -i
            chains[at].append((j, i))
    return [p for chain in chains for p in chain]


def align(shared: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (start in the earlier, start in the later, lines) that cover all of ``shared``: units (place
    in the later document, first place in the earlier, lines) of one pair of documents."""
    shared = sorted(set(shared))
    later = [i for _, i, _ in shared]  # a unit is named by its place in the earlier document
    found = patience_blocks(sorted(set(later)), later)
    aligned = [k for _, at, n in found for k in range(at, at + n)]
    rest = sorted(set(range(len(shared))) - set(aligned))
    where = {shared[k][:2]: k for k in rest}
    order = aligned + [where[p] for p in _moved([shared[k][:2] for k in rest])]
    seen: set[int] = set()
    lines = []
    for k in order:
        j, i, n = shared[k]
        for step in range(n):
            if j + step not in seen:
                seen.add(j + step)
                lines.append((i + step, j + step))
    return _blocks(lines)


def units_of(text: str | None) -> list[tuple[int, int, int]]:
    """(hash, place, lines) of a text's units; places count the lines that aren't blank."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    lines = [x for line in (text or "").split("\n") if (x := line.strip(_BLANK))]
    sizes = [len(x) for x in lines]
    names = [digest(x.encode("utf-8", "surrogatepass")) for x in lines]
    out = []
    for at, size in enumerate(sizes):
        if size >= LEAST_CHARS:
            out.append((names[at], at, 1))
            continue
        for step in (1, -1):
            total, end = size, at
            while total < LEAST_CHARS and 0 <= end + step < len(lines):
                end += step
                total += sizes[end]
            low, high = min(at, end), max(at, end)
            if total >= LEAST_CHARS:
                run = b"".join(x.to_bytes(8, "little") for x in names[low : high + 1])
                out.append((digest(run, 1), low, high - low + 1))
    if lines and not out:
        out.append((digest("\n".join(lines).encode("utf-8", "surrogatepass"), 2), 0, len(lines)))
    return sorted({(h - (1 << 64) if h >> 63 else h, at, n) for h, at, n in out}, key=lambda u: u[1:])


def _key(docs: DataFrame) -> Column:
    """What tells rows of a doc_id apart: their text."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def document_units(docs: DataFrame) -> DataFrame:
    """(id, key, units array<struct<h,at,n>>), a row for each text of a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                units = [[dict(zip(("h", "at", "n"), u, strict=True)) for u in units_of(t.as_py())] for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(units, kind)], names=["id", "key", "units"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), _key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    rows = rows.where("id is not null").mapInArrow(tidy(run), "id bigint, key bigint, units array<struct<h:bigint,at:int,n:int>>")
    return rows.where(F.size("units") > 0).dropDuplicates(["id", "key"])


def common_blocks(docs: DataFrame) -> DataFrame:
    """(id, key, blocks): for documents with lines to lose, the common blocks that alignment found, as
    array<struct<partner,partner_start,start,lines>>; places count lines that aren't blank."""
    n = parallelism(docs.sparkSession)
    table = write_table(document_units(docs), "lines-units")
    rows = table.select("id", "key", F.explode("units").alias("u")).select("id", "key", "u.h", "u.at", "u.n")
    stats = rows.groupBy("h").agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count("*").alias("df")).where("df > 1")
    stats = stats.select(F.col("h").alias("line"), F.col("first.id").alias("fid"), F.col("first.key").alias("fkey"), F.col("first.at").alias("fat"), "df")
    stats = write_table(stats, "lines-stats")
    total = table.agg(F.sum(F.size("units"))).first()[0] or 0
    limit = max(2, total // (HOT * n))  # at most HOT * n units are held more often
    later = (F.col("id") > F.col("fid")) | ((F.col("id") == F.col("fid")) & (F.col("key") > F.col("fkey")))
    hot, cold = stats.where(F.col("df") > limit), stats.where(F.col("df") <= limit)
    shared = rows.join(F.broadcast(hot), F.col("h") == F.col("line")).unionByName(rows.join(cold.hint("merge"), F.col("h") == F.col("line")))
    shared = shared.where(later).select("id", "key", F.struct("fid", "fkey", "at", "fat", "n", "df").alias("s"))
    shared = shared.groupBy("id", "key").agg(F.collect_list("s").alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("partner", pa.int64()), ("partner_start", pa.int32()), ("start", pa.int32()), ("lines", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for units in part.column(2).to_pylist():
                    pairs: dict = {}
                    for u in units:
                        pairs.setdefault((u["fid"], u["fkey"]), []).append(u)
                    taken: set[int] = set()
                    blocks = []
                    for partner, mine in sorted(pairs.items(), key=lambda p: (min(u["df"] for u in p[1]), p[0])):
                        for i, j, lines in align([(u["at"], u["fat"], u["n"]) for u in mine]):
                            fresh = [(i + k, j + k) for k in range(lines) if j + k not in taken]
                            taken.update(j for _, j in fresh)
                            blocks += [dict(partner=partner[0], partner_start=i, start=j, lines=k) for i, j, k in _blocks(fresh)]
                    out.append(blocks)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["id", "key", "blocks"])

    found = shared.mapInArrow(tidy(run), "id bigint, key bigint, blocks array<struct<partner:bigint,partner_start:int,start:int,lines:int>>")
    found = write_table(found, "lines-blocks")
    drop_table(stats)
    drop_table(table)
    return found


def _cut(text: str, blocks: list[dict]) -> tuple[str, int, int]:
    """(what stays, lines, lines that go).  A blank line goes if those around it go, one side at the ends."""
    lines = text.split("\n")
    gone = {k for b in blocks for k in range(b["start"], b["start"] + b["lines"])}
    state, at = [], 0
    for line in lines:
        full = bool(line.strip(_BLANK))
        state.append(at in gone if full else None)
        at += full
    before, after, last = [], [], True
    for s in state:
        last = last if s is None else s
        before.append(last)
    last = True
    for s in reversed(state):
        last = last if s is None else s
        after.append(last)
    keep = [line for line, b, a in zip(lines, before, reversed(after), strict=True) if not (a and b)]
    return "\n".join(keep), len(lines), len(lines) - len(keep)


def _with_cuts(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and __kept (null: nothing goes), __lines, __removed, __partners."""
    found = common_blocks(docs).select(F.col("id").alias("__later"), F.col("key").alias("__text"), F.col("blocks").alias("__blocks"))
    keyed = docs.withColumn("__key", _key(docs)).withColumn("__id", F.coalesce(docs["doc_id"].cast("bigint"), F.col("__key")))
    same = (keyed["__key"] == found["__text"]) & (keyed["__id"] == found["__later"]) & keyed["doc_id"].isNotNull()
    # Texts are shuffled at every size: what goes may be as large as the table, so it isn't broadcast.
    rows = keyed.join(found.hint("merge"), same, "left").drop("__key", "__id", "__later", "__text")
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                new = []
                for text, blocks in zip(part.column(where), part.column(part.num_columns - 1), strict=True):
                    text, blocks = text.as_py() or "", blocks.as_py()
                    if blocks:
                        new.append((*_cut(text, blocks), len({b["partner"] for b in blocks})))
                    else:
                        new.append((None, text.count("\n") + 1, 0, 0))
                more = [pa.array(c, t) for c, t in zip(zip(*new, strict=True), types, strict=True)]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[f"c{i}" for i in range(len(columns) + 4)])

    types = (StringType(), IntegerType(), IntegerType(), IntegerType())
    flat = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]
    flat[where] = F.col("text").cast("string").alias(f"c{where}")
    rows = rows.select(*flat)
    schema = StructType([*rows.schema.fields[:-1], *(StructField(f"c{len(flat) - 1 + i}", t) for i, t in enumerate(types))])
    return rows.mapInArrow(tidy(run), schema).toDF(*docs.columns, "__kept", "__lines", "__removed", "__partners")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, partners, kept): a row for each row of ``docs``; ``kept`` is the
    text that stays.

    Defined cases: a null text is one empty line; rows with a null doc_id keep all and take from none;
    repeated rows lose the same lines; of different texts that share a doc_id one is the earlier;
    blank lines go with what is around them; an empty table gives none.
    """
    out = _with_cuts(docs.select("doc_id", "text"))
    kept = F.coalesce("__kept", "text", F.lit(""))
    return out.select("doc_id", *(F.col(f"__{c}").cast("bigint").alias(n) for c, n in (("lines", "n_lines"), ("removed", "n_removed"), ("partners", "partners"))), kept.alias("kept"))


@any_names
def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, less the aligned common blocks of later documents; n_chars, where
    there is such a column, follows.  Documents of which nothing but blanks stays are left out."""
    out = _with_cuts(docs).where(r"__kept is null or __kept rlike '[^\\x20\\x09-\\x0D]'")
    out = out.withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
