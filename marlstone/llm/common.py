"""Helpers shared by the operators: durable intermediate tables and row-safe keys."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The five ASCII blanks \\x09-\\x0D and the space: what separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session of one machine has none (tests), a temporary folder is set for it; on a cluster that
    would be a folder of the driver's own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    The files outlive any executor, so a lost one costs the reading of a split and no more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table of ``write_table`` that nothing reads any more."""
    path = getattr(df, "_marlstone_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def any_names(operator):
    """For an operator whose first argument is a table and whose result keeps its columns: those whose names begin with
    two underscores, as the operators' own do, travel under names that nothing else has."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        prefix = "extra"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        names = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        if not names:
            return operator(docs, *args, **kwargs)
        return operator(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: k for k, v in names.items()})

    return run


def tidy(function):
    """A function of a Python worker, batches to batches, that gives free memory back to the system when it ends:
    workers are reused, and what one operator's task held would count against the next one's."""

    def run(batches):
        yield from function(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


#: A key held by more than one in ``HOT x partitions`` rows is joined by broadcast.
HOT = 8


def join_split(rows: DataFrame, by: str, table: DataFrame, value: str, count: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``table`` where ``by`` equals its ``value`` (unique); ``count`` says how many of
    the ``total`` rows hold it.

    The values held by more than their share, at most ``HOT x partitions``, are broadcast; rows that these, or
    a null, settle are spread by ``spread``, so no key is hot in the shuffle that joins the others.
    """
    limit = max(2, total // (HOT * parallelism(rows.sparkSession)))
    others = [c for c in table.columns if c not in (value, count)]
    hot = table.where(F.col(count) > limit).select(F.col(value).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in others))
    cold = table.where(F.col(count) <= limit).select(F.concat(F.lit("="), F.col(value)).alias("__cold"), *(F.col(c).alias(f"__cold_{c}") for c in others))
    out = rows.join(F.broadcast(hot), F.col(by) == F.col("__hot"), "left")
    wanted = F.col("__hot").isNull() & F.col(by).isNotNull()
    key = F.when(wanted, F.concat(F.lit("="), F.col(by))).otherwise(F.concat(F.lit("#"), F.pmod(spread, F.lit(4096)).cast("string")))
    out = out.withColumn("__key", key).join(cold, F.col("__key") == F.col("__cold"), "left")
    return out.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in others))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def constant_array(values, kind: str) -> Column:
    """A constant array, however long: one literal, which the optimizer folds."""
    text = ",".join(map(repr, values))
    return F.split(F.lit(text), ",").cast(f"array<{kind}>") if text else F.array().cast(f"array<{kind}>")


def count_below(n: int, below) -> Column:
    """How many of ``n`` sorted entries a row's value is not below, by a binary search in generated steps:
    ``below(i)`` is whether entry ``i`` (a Column, from 0; null beyond the end) is at or below the value."""
    if not n:
        return F.lit(0)
    span = 1 << (n.bit_length() - 1)
    steps = constant_array((span >> i for i in range(span.bit_length())), "int")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step - 1), at + step).otherwise(at))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
