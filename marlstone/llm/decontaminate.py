"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned natively.

A benchmark item's windows are its runs of ``size`` words (an item of fewer words is one window).
The distinct windows, keyed by hash, form a table whose bytes are measured: within ``BROADCAST``
it is broadcast and documents are scanned where they lie; beyond, narrow rows (document, position,
hash) are joined by a shuffle, and the documents that have candidates are read once more.  Each hit
is verified word for word.  Within the bound documents are read once, and nothing but hits and one
narrow row a document is shuffled; a passage that very many documents hold costs each its own hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_names, lower_ascii, write_table

SIZE = 10
#: Bytes of windows and item lists up to which the set is broadcast.
BROADCAST = 32 * 1024 * 1024
#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _window_hashes(n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(h, k, window, owners): the distinct windows of ``items`` (item_id, text), with the ids, as
    strings, of the items that hold them.  Null and wordless texts have none."""
    words = items.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
    grouped = each.groupBy("window").agg(F.collect_set("item").alias("owners"))
    return grouped.select(F.xxhash64("window").alias("h"), F.size("window").alias("k"), "window", "owners")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast: int = BROADCAST) -> DataFrame:
    """For each row of ``docs``: doc_id, __text_hash, n_words, spans, n_hit, items.

    ``spans`` are the hit windows as array<struct<start,end>> in words, sorted; ``items`` the sorted
    string ids of the items that own them.  Windows of over ``broadcast`` bytes are joined by a shuffle.  Defined cases: null texts have no words; equal rows get
    equal results, one each; without items nothing is hit.
    """
    windows = write_table(item_windows(items, size), "windows")
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())  # size of them at most
    weight = windows.agg(F.sum(F.length(F.array_join("window", " ")) + 24 * F.size("window") + 40 * F.size("owners") + 64)).first()[0] or 0
    table = windows.select(F.col("h").alias("__h"), F.col("k").alias("__k"), "window", "owners")
    wide = weight <= broadcast

    base = docs.select(F.col("doc_id"), F.xxhash64(F.col("text")).alias("__text_hash"), _words(F.col("text")).alias("words"))
    n = F.size("words")
    # Position 0 stands for the document itself (its hash only spreads it, and meets nothing); then the
    # windows' hashes, one size after another.
    hashes = [F.array(F.lit(None).cast("bigint") if wide else F.xxhash64("doc_id", "__text_hash"))]
    for k in sizes:
        runs = _window_hashes(n, k)
        hashes.append(F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>")))
    rows = base.select("doc_id", "__text_hash", *(["words"] if wide else []), n.alias("n"), F.posexplode(F.concat(*hashes)).alias("p", "h"))
    n = F.col("n")
    start, length, first = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in sizes:
        count = F.greatest(n - (k - 1), F.lit(0))
        inside = (F.col("p") >= first) & (F.col("p") < first + count)
        start, length = F.when(inside, F.col("p") - first).otherwise(start), F.when(inside, F.lit(k)).otherwise(length)
        first = first + count
    table = F.broadcast(table) if wide else table.hint("merge")
    met = rows.join(table, (F.col("h") == F.col("__h")) & (F.col("p") > 0), "left").where("p = 0 or __h is not null")
    met = met.select("doc_id", "__text_hash", *(["words"] if wide else []), "n", "p", start.alias("s"), length.alias("k"), "__k", "window", "owners")
    if not wide:
        # The words of documents that have candidates, from a second look at these alone.
        met = write_table(met, "candidates")
        some = met.where("p > 0").select(F.col("doc_id").alias("d"), F.col("__text_hash").alias("t")).distinct()
        named = base.join(some, base["doc_id"].eqNullSafe(some["d"]) & (base["__text_hash"] == some["t"]), "left_semi").dropDuplicates(["doc_id", "__text_hash"])
        named = named.select(F.col("doc_id").alias("d"), F.col("__text_hash").alias("t"), "words")
        met = met.join(named, met["doc_id"].eqNullSafe(named["d"]) & (met["__text_hash"] == named["t"]), "left").drop("d", "t")
    hit = (F.col("k") == F.col("__k")) & (F.slice("words", F.col("s") + 1, F.col("k")) == F.col("window"))
    met = met.select(
        "doc_id", "__text_hash", "n", (F.col("p") == 0).alias("self"),
        F.when(hit, F.struct(F.col("s").alias("start"), (F.col("s") + F.col("k")).alias("end"))).alias("span"),
        F.when(hit, F.col("owners")).alias("owners"),
    ).where("self or span is not null")
    found = met.groupBy("doc_id", "__text_hash").agg(
        F.max("n").alias("n_words"), F.count(F.when(F.col("self"), 1)).cast("int").alias("copies"),
        F.collect_set("span").alias("spans"), F.collect_set("owners").alias("owners"),
    )
    cover = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n")
    )
    found = found.select(
        "doc_id", "__text_hash", F.col("n_words").cast("bigint").alias("n_words"), F.array_sort("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("owners"))).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    )
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), cover)["n"]
    return found.select("doc_id", "__text_hash", "n_words", "spans", covered.cast("bigint").alias("n_hit"), "items")


@any_names
def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, remove: str = "documents") -> DataFrame:
    """``docs`` with its columns, less the contaminated documents (``remove="documents"``) or less
    the hit words and the separators before them (``remove="spans"``; n_chars, where there is such a
    column, follows)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, got {remove}")
    hits = contamination(docs, items, size).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("__text_hash").alias("__t"), F.col("spans").alias("__spans"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    if remove == "documents":
        return docs.join(hits.drop("__spans"), same, "left_anti")
    hits = hits.dropDuplicates(["__id", "__t"])
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all("text", F.lit(piece), F.lit(0))
    left = F.filter(pieces, lambda x, i: ~F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    rest = F.regexp_extract("text", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(left, ""), rest))
    out = docs.join(hits, same, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
