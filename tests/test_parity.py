"""Every function with an SQL twin, against DuckDB on the driver's tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.plans.oracle_sql import oracle_sql
from marlstone.plans.panel import Panel
from marlstone.plans.queries import FAMILIES, NUDGE, is_reducing
from marlstone.sources.bars import market

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _flat(rows):
    out = {}
    for r in rows:
        key = (r["symbol"], r["t"]) if "t" in r else (r["symbol"],)
        out[key] = r["v"].asDict() if hasattr(r["v"], "asDict") else {"value": r["v"]}
    return out


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or abs(a - b) <= 2e-6 + 1e-9 * abs(a)


@pytest.mark.parametrize("family", sorted(FAMILIES))
@pytest.mark.parametrize("part", range(4))
def test_parity(spark, tables, family, part):
    module, specs = FAMILIES[family]
    sql = oracle_sql()
    base = market(spark, FOLDER).cache()
    chosen = [n for n in sorted(specs) if f"{family}_{n}" in sql][part::4]
    for reducing in (False, True):
        names = [n for n in chosen if is_reducing(family, n) == reducing]
        if not names:
            continue
        panel = Panel(base, ["symbol"], ["t"])
        columns = {f"v_{n}": getattr(module, n)(*(F.col(c) for c in specs[n][0]), **specs[n][1], over=panel) for n in names}
        rows = (panel.metrics(**columns) if reducing else panel.with_studies(**columns)).collect()
        for n in names:
            got = _flat([{"symbol": r["symbol"], "v": r[f"v_{n}"]} | ({} if reducing else {"t": r["t"]}) for r in rows])
            result = tables.execute(sql[f"{family}_{n}"])
            heads = [d[0] for d in result.description]
            keys = 1 if reducing else 2
            want = {tuple(r[:keys]): dict(zip(heads[keys:], r[keys:], strict=True)) for r in result.fetchall()}
            assert got.keys() == want.keys(), n
            for key, lanes in want.items():
                for lane, value in lanes.items():
                    assert _close(None if got[key][lane] is None else got[key][lane] + NUDGE, value), (n, key, lane, got[key][lane], value)
