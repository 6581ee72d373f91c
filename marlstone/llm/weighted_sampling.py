"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A document's terms are its words, weighted by how often they occur.  Sample i of a term with weight
w has r, c ~ Gamma(2, 1) and b ~ U(0, 1), drawn from the term's hash and i alone, and the value
ln c - r (floor(ln w / r + b) - b + 1); the document's sample is the term and step with the smallest
value.  Two documents agree on a sample with a probability equal to the generalised Jaccard
similarity of their weights.  The smallest value itself identifies term and step, so a fingerprint
keeps 16 bits of its hash: 4 hexadecimal digits a sample.

Scale: documents are dealt once, by runs of neighbouring doc_ids that end at quantiles, so that a
document's successor is in the same task but for the last of a run; words are counted and samples taken without another
shuffle.  The smallest values are plain running minima in generated code.

Logarithms are most of the work, and few terms need them: e^value of a term of weight w is exponential with rate w,
so a document's smallest is below LIKELY / (its total weight) but with probability e^-LIKELY.  Terms that a bound
without logarithms puts above that limit are passed over.  A document one of whose samples did not come out below
its limit is taken again from all its terms, so the result is that of all terms at any LIKELY.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, constant_array, count_below, parallelism, write_table

SAMPLES = 64
#: Samples taken in one pass over the terms; small enough for compiled code.
PASS = 8
#: Runs of documents a partition, about.
RUNS = 8
#: Limit on e^value times the total weight, beyond which terms are passed over at first.
LIKELY = 20.0
#: What a document's row of position 0 carries: its id, its length, and the edited text's SHA-256 in four parts.
_FACTS = ["doc_id", "n_chars", "e0", "e1", "e2", "e3"]
_DIGITS = 4


def _runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``tie``, which orders equal doc_ids, and their run: equal for neighbours,
    ascending with (doc_id, tie), null doc_ids first.

    Runs end at quantiles of the doc_ids, so they are of like size however the ids lie.  A doc_id (or the null
    one) that spans several quantiles is split by the tie, a hash of the text, at even steps.
    """
    spark = docs.sparkSession
    wanted = RUNS * parallelism(spark)
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n, some = docs.agg(F.count("*"), F.count("doc_id")).first()
    steps = max(1, min(wanted, some))
    shares = constant_array((i / steps for i in range(1, steps)), "double")
    found = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 8 * steps)))).first()[0] if steps > 1 else []
    bounds: list[tuple[int, int]] = []
    for doc_id, times in sorted(Counter(found).items()):
        parts = times + 1 if times > 1 else 1
        bounds += [(doc_id, -(1 << 63) + i * ((1 << 64) // parts)) for i in range(parts)]
    null_parts = max(1, min(wanted, wanted * (n - some) // max(n, 1)))
    null_run = F.floor(F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 32) * F.lit(null_parts) / F.lit(2.0**32)) - null_parts
    ids, ties = (constant_array((b[i] for b in bounds), "bigint") for i in (0, 1))

    def below(i: Column) -> Column:
        return (F.get(ids, i) < F.col("doc_id")) | ((F.get(ids, i) == F.col("doc_id")) & (F.get(ties, i) <= F.col("tie")))

    at = count_below(len(bounds), below)
    return docs.withColumn("run", F.when(F.col("doc_id").isNull(), null_run).otherwise(at).cast("bigint"))


def _following(runs: DataFrame) -> DataFrame:
    """(run, next_run) for each run; the last is followed by the first.  Two levels of windows: no
    task sorts more than the runs of one stretch, or one row a stretch."""
    stretch = 65_536
    runs = runs.withColumn("stretch", F.floor(F.col("run") / stretch))
    inner = runs.select("run", "stretch", F.lead("run").over(Window.partitionBy("stretch").orderBy("run")).alias("next_run"))
    heads = runs.groupBy("stretch").agg(F.min("run").alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("stretch")
    heads = heads.select("stretch", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy(F.lit(0)))).alias("after"))
    return inner.join(heads, "stretch").select("run", F.coalesce("next_run", "after").alias("next_run"))


def _uniform(x: Column, shift: int, bits: int) -> Column:
    cut = F.shiftrightunsigned(x, shift) if shift else x
    return (cut.bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * F.lit(2.0**-bits)


def _draws(first: Column, second: Column) -> tuple[Column, Column, Column]:
    """(e^-r, e^-c, b) of a sample, from its two hashes."""
    return _uniform(first, 0, 21) * _uniform(first, 21, 21), _uniform(second, 0, 32) * _uniform(second, 32, 32), _uniform(first, 42, 22)


def _value(log_c: Column, r: Column, b: Column, weight: Column) -> Column:
    step = F.when(weight == 0, 0.0).otherwise(F.floor(weight / r + b).cast("double"))  # of weight 1: b < 1
    return log_c - r * (step - b + 1.0)


def _may_be_least(p: Column, q: Column, b: Column, weight: Column, limit: Column) -> Column:
    """False only where e^value is above ``limit``, by bounds without logarithms: c = -ln q >= 2 (1 - q) / (1 + q), and
    e^value / c is p^(1 - b) >= p / (p + (1 - b) (1 - p)) for weight 1, at least p / weight for any."""
    below = F.when(weight == 1.0, p + (1.0 - b) * (1.0 - p)).otherwise(weight)
    return 2.0 * (1.0 - q) * p <= limit * (1.0 + q) * below


def signatures(words: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES, facts: Sequence[str] = (), limit: str | None = None) -> DataFrame:
    """For each group of ``keys`` an array of ``samples`` codes for each of ``weights``, and ``sure``.

    ``words`` has a row for each term of a group: ``term`` (its hash, bigint) and weight columns
    (null or 0: absent).  ``weights``: name of the signature -> weight column.
    ``facts``: further columns, of which a group's greatest value is kept.
    ``limit``: a column, the same for a group's rows; terms whose e^value is surely above it may be passed over.
    A group is ``sure`` if all its smallest values are below, so that no term passed over can matter.
    """
    passes = math.ceil(samples / PASS)
    most = F.greatest(*(F.coalesce(F.col(w), F.lit(0)) for w in weights.values()), F.lit(1)).cast("double")
    # Above the limit by more than the bounds' rounding errors.
    bound = [] if limit is None else [(F.col(limit) * (1.0 + 1e-9)).alias("limit"), most.alias("most")]
    wide = words.select(*keys, "term", *facts, *bound, *(F.when(F.col(w) > 0, F.ln(w)).alias(f"ln_{name}") for name, w in weights.items()), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    wide = wide.withColumn("seed", F.xxhash64("term", "pass")).drop("term")
    wide = wide.select("*", *(F.xxhash64(F.col("seed").bitwiseXOR(F.lit(j))).alias(f"x{j}") for j in range(PASS)))
    wide = wide.select("*", *(F.xxhash64(f"x{j}").alias(f"y{j}") for j in range(PASS)))
    kept = [c for c in wide.columns if not c.startswith("y")]
    logs = []
    for j in range(PASS):
        p, q, b = _draws(F.col(f"x{j}"), F.col(f"y{j}"))
        needed = F.lit(True) if limit is None else _may_be_least(p, q, b, F.col("most"), F.col("limit"))
        logs += [F.when(needed, F.ln(-F.ln(q))).alias(f"c{j}"), F.when(needed, -F.ln(p)).alias(f"r{j}")]
    wide = wide.select(*kept, *logs)
    value = lambda name, j: _value(F.col(f"c{j}"), F.col(f"r{j}"), _uniform(F.col(f"x{j}"), 42, 22), F.col(f"ln_{name}"))
    least = [F.min(value(name, j)).alias(f"{name}_{j}") for name in weights for j in range(PASS)]
    some = [F.max(f"ln_{name}").alias(f"some_{name}") for name in weights] + ([] if limit is None else [F.max("limit").alias("limit")])
    part = wide.groupBy(*keys, "pass").agg(*least, *some, *(F.max(x).alias(x) for x in facts))
    sure = F.lit(True)
    if limit is not None:
        for name in weights:
            greatest = [F.coalesce(F.col(f"{name}_{j}"), F.lit(math.inf)) for j in range(PASS)]
            sure = sure & (F.col(f"some_{name}").isNull() | (F.greatest(*greatest) < F.ln("limit") - 1e-8))
    code = lambda c: F.coalesce(F.xxhash64(c).bitwiseAND(F.lit((1 << 4 * _DIGITS) - 1)), F.lit(0)).cast("int")
    part = part.select(*keys, "pass", *facts, sure.alias("sure"), *(F.array(*(F.when(F.col(f"{name}_{j}").isNull(), 0).otherwise(code(f"{name}_{j}")) for j in range(PASS))).alias(name) for name in weights))
    whole = part.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.struct("pass", F.col(name).alias("codes")))).alias(name) for name in weights), F.min("sure").alias("sure"), *(F.max(x).alias(x) for x in facts))
    return whole.select(*keys, *facts, *(F.slice(F.flatten(F.transform(name, lambda s: s["codes"])), 1, samples).alias(name) for name in weights), "sure")


def to_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), _DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a).cast("double")


def _edited_terms(rows: DataFrame) -> DataFrame:
    """(run, rank, term, w_own, w_changed, total, facts) of the words of each row's own and edited text."""
    # Words of the part that both texts share are counted once; the cut may fall within a word.
    sha = F.sha2(F.concat("kept", "new"), 256)
    about = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_chars").cast("string"), *(F.substring(sha, 16 * i + 1, 16) for i in range(4)))
    words = rows.select("run", "rank", about.alias("about"), F.split("kept", BLANKS).alias("kept"), "rest", "new")
    last = F.element_at("kept", -1)
    words = words.select("run", "rank", "about", F.slice("kept", F.lit(1), F.size("kept") - 1).alias("kept"), F.split(F.concat(last, "rest"), BLANKS).alias("rest"), F.split(F.concat(last, "new"), BLANKS).alias("new"))
    # Position 0 is a word of no weight, for the document itself: what is about it travels there, past the counting.
    a, b = F.size("kept"), F.size("kept") + F.size("rest")
    # At least so many words on either side: three may be empty, at the ends of the parts.
    total = F.greatest(F.least(b, a + F.size("new")) - 3, F.lit(1))
    words = words.select("run", "rank", "about", a.alias("a"), b.alias("b"), total.alias("total"), F.posexplode(F.concat(F.array(F.lit("")), "kept", "rest", "new")).alias("p", "word")).where("word <> '' or p = 0")
    own, changed = (F.col("p") > 0) & (F.col("p") <= F.col("b")), ((F.col("p") > 0) & (F.col("p") <= F.col("a"))) | (F.col("p") > F.col("b"))
    words = words.select("run", "rank", "total", F.when(F.col("p") == 0, F.col("about")).alias("about"), F.xxhash64("word").alias("term"), own.cast("int").alias("own"), changed.cast("int").alias("changed"))
    words = words.groupBy("run", "rank", "term", "about").agg(F.sum("own").alias("w_own"), F.sum("changed").alias("w_changed"), F.max("total").alias("total"))
    field = lambda i: F.split("about", r"\|")[i]
    facts = {"doc_id": F.when(field(0) != "", field(0).cast("bigint")), "n_chars": field(1).cast("bigint")}
    facts |= {f"e{i}": F.conv(field(2 + i), 16, -10).cast("bigint") for i in range(4)}
    return words.select("run", "rank", "term", "w_own", "w_changed", "total", *(c.alias(k) for k, c in facts.items()))


def edited_pairs(docs: DataFrame, samples: int = SAMPLES, likely: float = LIKELY) -> DataFrame:
    """(doc_id, n_chars, edited, own, changed, following): signatures of each text, of its edited text,
    and of the next document's text; ``edited`` is a SHA-256.

    The edited text: the last floor(n_chars / 4) code points replaced by the first as many, or all, of
    the next document's (ascending doc_id, after the last the first).  Defined cases: a null text is
    empty; an empty or blank text's samples are all 0, so such texts are alike; equal doc_ids are
    ordered by a hash of the text; null doc_ids come first; an only document follows itself.
    """
    docs = _runs(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    order = Window.partitionBy("run").orderBy("doc_id", "tie", "text")
    follows = write_table(_following(docs.select("run").distinct()), "sampling-runs")
    # A run's first text, from the same shuffle as the rows themselves.
    texts = docs.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("run", F.col("text").alias("head"))
    after = follows.join(texts.withColumnRenamed("run", "next_run"), "next_run").select(F.col("run").alias("r"), "head")

    rows = docs.select("run", "doc_id", "text", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("next"))
    rows = rows.join(after, rows["run"] == after["r"], "left").select("run", "rank", "doc_id", "text", F.coalesce("next", "head", "text").alias("next"))
    n = F.length("text")
    rows = rows.select("run", "rank", "doc_id", n.alias("n_chars"), F.floor(n / 4).cast("int").alias("cut"), "text", "next")
    kept = F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut"))
    rest = F.substring("text", F.col("n_chars") - F.col("cut") + 1, F.col("cut"))
    rows = rows.select("run", "rank", "doc_id", "n_chars", kept.alias("kept"), rest.alias("rest"), F.substring("next", F.lit(1), F.col("cut")).alias("new"))

    def codes(chosen: DataFrame, limit: str | None = None) -> DataFrame:
        words = _edited_terms(chosen).withColumn("limit", F.lit(likely) / F.col("total"))
        out = signatures(words, ["run", "rank"], {"own": "w_own", "changed": "w_changed"}, samples, _FACTS, limit)
        sha = F.lower(F.concat(*(F.lpad(F.hex(f"e{i}"), 16, "0") for i in range(4))))
        return out.withColumn("edited", sha).drop(*(f"e{i}" for i in range(4)))

    table = write_table(codes(rows, "limit"), "sampling-signatures")
    unsure = table.where(~F.col("sure")).select("run", "rank")
    if not unsure.isEmpty():
        again = write_table(codes(rows.join(unsure, ["run", "rank"], "left_semi")), "sampling-again")
        table = table.where("sure").unionByName(again)
    first = table.where("rank = 1").select(F.col("run").alias("next_run"), F.col("own").alias("head"))
    after = follows.join(first, "next_run").select(F.col("run").alias("r"), "head")
    out = table.withColumn("next", F.lead("own").over(Window.partitionBy("run").orderBy("rank")))
    out = out.join(after, out["run"] == after["r"], "left")
    return out.select("doc_id", "n_chars", "edited", "own", "changed", F.coalesce("next", "head").alias("following"))
