"""Connected components of a link table, distributed: local forests, then contraction rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, tidy, write_table


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of one task, as (child, root) with root < child; a task holds
    at most ``HELD`` nodes, then emits its forest and starts another."""
    held, parent = 1_000_000, {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = p
        return x

    def flush():
        rows = [(k, find(k)) for k in list(parent)]
        rows = [(a, b) for a, b in rows if a != b]
        if rows:
            a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > held:
            yield from flush()
            parent.clear()
    yield from flush()


def connected_components(links: DataFrame) -> DataFrame:
    """(node bigint, root bigint) for every node of the links (a, b): equal roots, one component.

    Each round every node points to its smallest neighbour in an order that the round's seed
    shuffles, pointers are followed twice, and the links are rewritten between the roots reached;
    long chains shrink by a constant factor a round whatever their ids.  The tables between rounds
    lie in the shared folder.  A link of a node to itself makes it a component.  Nulls are ignored.
    """
    links = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a is not null and b is not null")
    edges = write_table(links.mapInArrow(tidy(_forest), "a bigint, b bigint").distinct(), "components-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    loops = links.where("a = b").select(F.col("a").alias("node")).distinct()
    steps: list[DataFrame] = []
    seed = 0
    while edges.limit(1).count():
        rank = lambda c, s=seed: F.xxhash64(c, F.lit(s))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("best"))
        point = point.select(
            F.col("a").alias("node"), F.when(F.col("best.r") < rank("a"), F.col("best.to")).otherwise(F.col("a")).alias("to")
        )
        point = write_table(point, "components-step")
        for _ in range(2):
            other = point.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
            jumped = write_table(point.join(other, point["to"] == other["n2"]).select("node", F.col("t2").alias("to")), "components-step")
            drop_table(point)
            point = jumped
        steps.append(point)
        pa_, pb_ = (point.select(F.col("node").alias(f"n{s}"), F.col("to").alias(f"t{s}")) for s in "ab")
        moved = edges.join(pa_, edges["a"] == pa_["na"]).join(pb_, F.col("b") == pb_["nb"])
        moved = moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct()
        fresh = write_table(moved.mapInArrow(tidy(_forest), "a bigint, b bigint").distinct(), "components-edges")
        if seed:
            drop_table(edges)
        edges = fresh
        seed += 1
    out = nodes.select("node", F.col("node").alias("root"))
    for step in steps:
        step = step.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        out = out.join(step, out["root"] == step["n2"], "left").select("node", F.coalesce("t2", "root").alias("root"))
    alone = loops.join(nodes, "node", "left_anti").select("node", F.col("node").alias("root"))
    return out.unionByName(alone)
