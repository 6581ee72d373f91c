"""Language identification by Bayesian evidence fusion.

posterior(l) ~ text(l) + log P(declared | l) + log P(address suffix | l) + log P(l | host)

The text's likelihood is that of its letter trigrams (all of them, of the whole text) in each
language, as a mean a trigram, times ``TRIGRAMS`` at most, so that other evidence can weigh against
it.  What a declared language (markup, metadata) and an address suffix tell is counted, over all
rows, by grouped aggregation against the text's own verdict; the host's prior likewise, smoothed
towards its domain's and that towards the whole corpus's.  A row's own verdict is taken out of the
counts that judge it, so a text weighs once.

The languages are those that the labels of all rows name (the ``LANGUAGES`` commonest).  The trigram
tables are fitted on a bounded sample of each: ``SAMPLE`` rows, those with the smallest hash of their
id; executors count, the driver gets counts alone.  Where the label is evidence too, as a declared
language, tables are fitted in ``folds``: a row is scored by those of the other folds, so that what it
declares does not count a second time as the label of its own text.
Counts of values that hold more than their share of rows are joined by a broadcast table of at most
``HOT x partitions`` rows, so that no host is hot in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import any_names, join_split, tidy, write_table

#: Labelled rows of each language that the trigram tables are fitted on, at most.
SAMPLE = 1_000
#: Languages, at most: the commonest.
LANGUAGES = 500
TRIGRAMS = 100
CELLS = 15
#: Weight, in rows, of the level above in a smoothed prior.
WEIGHT = 10.0
#: Parts of the fitting sample where labels are evidence as well.
FOLDS = 2
#: Below this posterior, or without letters, a text is rejected.
CONFIDENCE = 0.5


def _trigram_cells():
    """A function from text to the cells of its letter trigrams (a blank counts as a border)."""
    letters = np.array([chr(i).isalpha() for i in range(0x3000)])

    def cells(text) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(letters[np.minimum(x, 0x2FFF)] | (x >= 0x3000), x, 32).astype(np.uint64)
        x = np.concatenate([[np.uint64(32)], x, [np.uint64(32)]])
        a, b, c = x[:-2], x[1:-1], x[2:]
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - CELLS)).astype(np.int64)[b != 32]

    return cells


def fold_of(row_id: Column, folds: int) -> Column:
    """The fold of a row: rows that share an id share it."""
    return F.pmod(F.xxhash64(row_id.cast("bigint")), F.lit(folds)).cast("int")


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, folds: int = 1) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [cell, language]) of labelled rows (doc_id, text, lang).

    With several ``folds`` the tables are [fold, cell, language], a fold's being those of the other folds' rows.
    Of rows that repeat an id and a language one text is taken; an id of several languages counts in each.
    """
    docs = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in rows)
    # Ids first: what tasks send for the smallest hashes is narrow, and texts come of the chosen alone.
    ids = docs.where(F.col("lang").isin(names)).select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()
    # Hashes are uniform: a threshold of a language's own leaves about twice the sample to be ranked.
    share = F.element_at(F.create_map(*(x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * sample / r["count"]))))), F.col("l")) if rows else F.lit(1.0)
    ids = ids.where((F.shiftrightunsigned(F.xxhash64("id").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 11) * F.lit(2.0**-53)) < share)
    order = Window.partitionBy("l").orderBy(F.xxhash64("id"), "id")
    picked = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("rank")
    chosen = docs.join(F.broadcast(picked), (docs["doc_id"] == picked["id"]) & (docs["lang"] == picked["l"])).groupBy("id", "l").agg(F.min("text").alias("text"))
    number = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = _trigram_cells(), {}
        for batch in batches:
            for lang, text, fold in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                n = held.setdefault((fold, number[lang]), np.zeros(1 << CELLS, np.int64))
                n += np.bincount(cells(text.as_py()), minlength=1 << CELLS)
        for (fold, i), n in held.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), fold, np.int32)), pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                names=["fold", "language", "cell", "n"],
            )

    counted = chosen.select("l", "text", fold_of(F.col("id"), folds)).mapInArrow(tidy(run), "fold int, language int, cell int, n bigint")
    found = counted.groupBy("fold", "language", "cell").agg(F.sum("n").alias("n")).toArrow()  # 2**CELLS rows a fold and language at most
    counts = np.zeros((folds, 1 << CELLS, max(1, len(names))))
    counts[found["fold"].to_numpy(), found["cell"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
    if folds > 1:
        counts = counts.sum(axis=0) - counts
    counts += 0.5
    table = np.log(counts / counts.sum(axis=1, keepdims=True))
    return names, table if folds > 1 else table[0]


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` (id, text_hash, declared, suffix, domain, host, text) with ``text`` replaced by
    ``letters`` (trigrams), ``fits`` (array<double>, one a language) and ``best`` (its number)."""
    languages, tables = model
    tables = tables.astype(np.float32).reshape(-1, *tables.shape[-2:])  # of each fold
    rows = rows.withColumn("fold", fold_of(F.col("id"), len(tables)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _trigram_cells()
        for batch in batches:
            fits, letters, best = [], [], []
            for text, fold in zip(batch.column(6), batch.column(7).to_pylist(), strict=True):
                at, table = cells(text.as_py()), tables[fold]
                total = np.zeros(table.shape[1])
                for i in range(0, len(at), 100_000):
                    total += table[at[i : i + 100_000]].sum(axis=0, dtype=np.float64)
                total = total / max(1, len(at)) * min(len(at), TRIGRAMS)
                letters.append(len(at))
                fits.append(total.tolist())
                best.append(int(total.argmax()) if len(at) and languages else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(6)), pa.array(letters, pa.int64()), pa.array(fits, pa.list_(pa.float64())), pa.array(best, pa.int32())],
                names=["id", "text_hash", "declared", "suffix", "domain", "host", "letters", "fits", "best"],
            )

    return rows.mapInArrow(tidy(run), "id bigint, text_hash bigint, declared string, suffix string, domain string, host string, letters bigint, fits array<double>, best int")


def _with_counts(rows: DataFrame, by: str, n: int, total: int) -> DataFrame:
    """``rows`` with ``{by}_c``: how many rows of the same value of ``by`` each language's verdict has, less the
    row's own; zeros where the value is null."""
    tally = rows.where(F.col(by).isNotNull() & F.col("best").isNotNull()).groupBy(F.col(by).alias("__value"))
    tally = tally.agg(F.count("*").alias("__rows"), F.array(*(F.count(F.when(F.col("best") == i, 1)).cast("double") for i in range(n))).alias("__counts"))
    tally = write_table(tally, f"language-{by}")
    out = join_split(rows, by, tally, "__value", "__rows", total, F.col("text_hash"))
    counts = F.col("__counts")
    own = F.array(*(F.coalesce((F.col("best") == i).cast("double"), F.lit(0.0)) for i in range(n)))
    out = out.withColumn(f"{by}_c", F.when(counts.isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(F.zip_with(counts, own, lambda x, y: x - y)))
    return out.drop("__counts")


def _smoothed(counts: Column, above: Column) -> Column:
    n = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, above, lambda x, p: (x + F.lit(WEIGHT) * p) / (n + WEIGHT))


def _logs(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(x))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(id, text_hash, language, confidence, text_language, letters, rejected), a row for each of
    ``rows`` (id, text, declared, suffix, domain, host; all but id and text may be null).

    Defined cases: a text without letters has no language and is rejected; null evidence weighs
    nothing; without any language to choose from all are rejected; equal rows get equal results.
    """
    languages = model[0]
    n = len(languages)
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "declared", "suffix", "domain", "host", "text")
    scored = write_table(text_evidence(rows, model), "language-evidence")
    if not n:
        none = F.lit(None).cast("string")
        return scored.select("id", "text_hash", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), "letters", F.lit(True).alias("rejected"))
    kinds = ("declared", "suffix", "domain", "host")
    found = scored.agg(*(F.count(F.when(F.col("best") == i, 1)) for i in range(n)), *(F.count(by) for by in kinds)).first()
    total, present = found[:n], [by for by, k in zip(kinds, found[n:], strict=True) if k]
    whole = F.array(*(F.lit((k + 1) / (sum(total) + n)) for k in total))

    fused = scored
    for by in present:
        fused = _with_counts(fused, by, n, sum(total))
    # The host's prior, smoothed by its domain's, and that by the corpus's.
    prior = whole
    for by in ("domain", "host"):
        if by in present:
            prior = _smoothed(F.col(f"{by}_c"), prior)
    evidence = F.zip_with("fits", _logs(prior), lambda a, b: a + b)
    for by in ("declared", "suffix"):
        if by in present:
            # P(value | language) = P(language | value) P(value) / P(language); P(value) is common to all.
            told = F.zip_with(_smoothed(F.col(f"{by}_c"), whole), whole, lambda x, p: F.ln(x / p))
            evidence = F.zip_with(evidence, told, lambda a, b: a + b)
    fused = fused.select("id", "text_hash", "letters", "best", evidence.alias("e")).withColumn("top", F.array_max("e"))
    confidence = 1.0 / F.aggregate("e", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    name = lambda i: F.element_at(F.array(*(F.lit(x) for x in languages)), (i + 1).cast("int"))
    some = F.col("letters") > 0
    out = fused.select("id", "text_hash", F.when(some, name(F.array_position("e", F.col("top")) - 1)).alias("language"), F.when(some, confidence).otherwise(0.0).alias("confidence"), name(F.col("best")).alias("text_language"), "letters")
    return out.withColumn("rejected", ~some | (F.col("confidence") < CONFIDENCE))


def document_rows(docs: DataFrame, declared: str | None = None) -> DataFrame:
    """Documents: ``source`` is their host, whose last label is an address suffix if it has several.  ``declared``
    names a column of declared languages; ``lang``, the label that tables are fitted to, is none unless asked for
    (fit in folds then)."""
    none = F.lit(None).cast("string")
    said = F.col(declared).cast("string") if declared else none
    source = F.col("source").cast("string")
    suffix = F.lower(F.regexp_extract(source, r"^[^\s/]+\.([A-Za-z][A-Za-z0-9-]*)$", 1))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"), said.alias("declared"), F.when(suffix != "", suffix).alias("suffix"), _domain(source).alias("domain"), source.alias("host"))


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages: the markup's ``lang``, the host and its last label; the text between tags."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    return pages.select(F.col("page_id").cast("bigint").alias("id"), text.alias("text"), F.when(declared != "", declared).alias("declared"), F.substring_index(host, ".", -1).alias("suffix"), _domain(host).alias("domain"), host.alias("host"))


@any_names
def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with its columns, less the rows that are rejected."""
    bad = identify(document_rows(docs), train(docs, sample)).where("rejected").select(F.col("id").alias("__id"), F.col("text_hash").alias("__t"))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__t"]), "left_anti")
