"""Panels: row-wise studies and per-series metrics of a DataFrame, planned into few stages.

A panel is a frame of evaluation that can also run sequential kernels.  Functions called with
``over=panel`` return plain Columns; where one needs a kernel, the panel notes the request and hands
out a reference to its lane.  ``with_studies`` then evaluates kernels level by level: those of a
level, and those fed by its lanes alone, share one grouped Arrow pass (one shuffle on the keys); equal
requests run once.  What is native stays in Catalyst: one exchange and sort for all windows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..core.over import Over
from ..operators.kernels import KERNELS

_LANE = re.compile(r"__lane_\d+_\d+")
_STAGE = re.compile(r"__stage_\d+_\d+")
_panels = count()


@dataclass
class _Request:
    kind: str
    inputs: list[Column]
    params: dict
    lanes: list[str]
    sources: list[str] = field(default_factory=list)


def _group_kernel(requests: list[tuple[str, list[str], dict, list[str]]], order: list[str]):
    """The function of a group's table that adds all lanes of a pass."""
    kernels = dict(KERNELS)

    def run(table: pa.Table) -> pa.Table:
        # Nulls first, as in Spark's windows: kernels and windows see one order.
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        lanes: dict[str, list] = {}
        for kind, inputs, params, outputs in requests:
            given = [lanes[i] if i in lanes else lanes.setdefault(i, table.column(i).to_pylist()) for i in inputs]
            lanes.update(zip(outputs, kernels[kind](*given, **params), strict=True))
        for _, _, _, outputs in requests:
            for name in outputs:
                table = table.append_column(name, pa.array(lanes[name], pa.float64()))
        return table

    return run


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Panel(Over):
    """``df`` as series: rows of equal ``keys`` in the order of ``order`` (column names; the order must
    be unique within a series; a null order comes first).  A series' rows meet in one task, as its recursions ask."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        for what, names in (("keys", keys), ("order", order)):
            for name in names:
                if not isinstance(name, str):
                    raise TypeError(f"a panel's {what} are column names, got {type(name).__name__}: put an expression into a column first")
                if name not in df.columns:
                    raise ValueError(f"no column {name} to take as a panel's {what}; there are {', '.join(df.columns)}")
        super().__init__([F.col(_quoted(k)) for k in keys], [F.col(_quoted(o)) for o in order])
        self.keys, self.order = list(keys), list(order)
        self.df, self._id = df, next(_panels)
        self._requests: dict[str, _Request] = {}
        self._known: dict[tuple, list[str]] = {}
        self._stages: dict[str, tuple[str, Column]] = {}

    def kernel(self, kind: str, inputs: Sequence[Column], lanes: Sequence[str], **params) -> list[Column]:
        key = (kind, tuple(map(str, inputs)), tuple(sorted(params.items())))
        if key not in self._known:
            names = [f"__lane_{self._id}_{len(self._requests) + i}" for i in range(len(lanes))]
            request = _Request(kind, list(inputs), params, names)
            self._requests.update(dict.fromkeys(names, request))
            self._known[key] = names
        return [F.col(n) for n in self._known[key]]

    def stage(self, column: Column) -> Column:
        """A column of its own, computed before what aggregates it."""
        text = str(column)
        if text not in self._stages:
            self._stages[text] = (f"__stage_{self._id}_{len(self._stages)}", column)
        return F.col(self._stages[text][0])

    def _needed(self, columns: Sequence[Column]) -> list[_Request]:
        found: dict[int, _Request] = {}

        def visit(text: str) -> None:
            for name in dict.fromkeys(_STAGE.findall(text)):
                visit(next(str(c) for n, c in self._stages.values() if n == name))
            for name in dict.fromkeys(_LANE.findall(text)):
                request = self._requests[name]
                if id(request) not in found:
                    for x in request.inputs:
                        visit(str(x))
                    found[id(request)] = request

        for c in columns:
            visit(str(c))
        return list(found.values())

    def _with_lanes(self, columns: Sequence[Column]) -> DataFrame:
        """The frame with the kernels' lanes that ``columns`` refer to."""
        df, level = self.df, {}
        requests = self._needed(columns)
        lane_of = {str(F.col(n)): n for r in requests for n in r.lanes}
        for r in requests:  # inputs come before what they feed
            levels = [0]
            for x in r.inputs:
                inner = [level[n] for n in _LANE.findall(str(x)) if n in level]
                if inner:
                    levels.append(max(inner) + (str(x) not in lane_of))
            level.update(dict.fromkeys(r.lanes, max(levels)))
        for at in range(max(level.values(), default=-1) + 1):
            now = [r for r in requests if level[r.lanes[0]] == at]
            native: dict[str, str] = {}
            plan = []
            for r in now:
                names = []
                for x in r.inputs:
                    text = str(x)
                    if text in lane_of:
                        names.append(lane_of[text])
                    else:
                        name = native.setdefault(text, f"__in_{self._id}_{at}_{len(native)}")
                        df = df if name in df.columns else df.withColumn(name, x.cast("double"))
                        names.append(name)
                plan.append((r.kind, names, r.params, r.lanes))
            # Plain names for the grouped function: those of the frame may hold dots.
            safe = {c: f"__plain_{i}" for i, c in enumerate(df.columns)}
            plan = [(kind, [safe.get(n, n) for n in names], params, lanes) for kind, names, params, lanes in plan]
            added = [n for r in now for n in r.lanes]
            plain = df.toDF(*safe.values())
            schema = StructType([*plain.schema.fields, *(StructField(n, DoubleType()) for n in added)])
            run = _group_kernel(plan, [safe[c] for c in self.order])
            grouped = plain.groupBy(*(safe[k] for k in self.keys)) if self.keys else plain.groupBy(F.lit(0))
            df = grouped.applyInArrow(run, schema).toDF(*df.columns, *added).drop(*native.values())
        return df

    def with_studies(self, **studies: Column) -> DataFrame:
        """The frame with a column for each study, by names that it doesn't have yet."""
        self._fresh(studies)
        df = self._with_lanes(list(studies.values()))
        return df.select(*map(_quoted, self.df.columns), *(c.alias(n) for n, c in studies.items()))

    def _fresh(self, named: dict[str, Column]) -> None:
        taken = {c.lower() for c in self.df.columns}
        if clash := [n for n in named if n.lower() in taken]:
            raise ValueError(f"the frame has columns {', '.join(clash)} already: choose other names")

    def metrics(self, **metrics: Column) -> DataFrame:
        """A row for each series: the keys and an aggregate for each metric, by name."""
        if clash := [n for n in metrics if n.lower() in {k.lower() for k in self.keys}]:
            raise ValueError(f"the keys are called {', '.join(clash)} too: choose other names")
        columns = list(metrics.values())
        df = self._with_lanes(columns)
        used = " ".join(map(str, columns))
        wanted: list[tuple[str, Column]] = []
        todo = list(dict.fromkeys(_STAGE.findall(used)))
        while todo:
            name = todo.pop()
            column = next(c for n, c in self._stages.values() if n == name)
            if name not in [n for n, _ in wanted]:
                wanted.append((name, column))
            todo += [n for n in _STAGE.findall(str(column)) if n != name]
        # Stages that don't feed each other are one projection: windows of a frame share a node.
        columns_of, level = dict(wanted), {}

        def depth(name: str) -> int:
            if name not in level:
                level[name] = 1 + max((depth(n) for n in _STAGE.findall(str(columns_of[name]))), default=-1)
            return level[name]

        for at in range(max(map(depth, columns_of), default=-1) + 1):
            df = df.withColumns({n: c for n, c in columns_of.items() if level[n] == at})
        aggregates = [c.alias(n) for n, c in metrics.items()]
        return df.groupBy(*map(_quoted, self.keys)).agg(*aggregates) if self.keys else df.agg(*aggregates)

    def with_metrics(self, **metrics: Column) -> DataFrame:
        """The frame with each series' metrics on all its rows."""
        if not self.keys:
            raise ValueError("a panel without keys has one row of metrics: take them from metrics()")
        self._fresh(metrics)
        rows = self.metrics(**metrics)
        named = rows.select(*(F.col(_quoted(k)).alias(f"__key_{i}") for i, k in enumerate(self.keys)), *metrics)
        same = [self.df[_quoted(k)].eqNullSafe(named[f"__key_{i}"]) for i, k in enumerate(self.keys)]
        on = same[0]
        for more in same[1:]:
            on = on & more
        return self.df.join(named, on, "left").select(*(self.df[_quoted(c)] for c in self.df.columns), *metrics)


