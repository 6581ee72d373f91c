"""Functions on small frames: types, parameters, warm-ups, nulls, NaN and known values."""

import inspect
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marlstone.core.ieee import div, ln, normal_cdf
from marlstone.functions import indicators, metrics, pnl
from marlstone.plans.panel import Panel
from marlstone.plans.queries import FAMILIES, is_reducing

NAN, INF = math.nan, math.inf
MODULES = (indicators, metrics, pnl)


def frame(spark, **lanes):
    n = max(map(len, lanes.values()))
    schema = StructType([StructField("k", LongType()), StructField("t", LongType()), *(StructField(c, DoubleType()) for c in lanes)])
    return spark.createDataFrame([(0, i, *(v[i] for v in lanes.values())) for i in range(n)], schema)


def study(spark, make, **lanes):
    panel = Panel(frame(spark, **lanes), ["k"], ["t"])
    return [r["v"] for r in panel.with_studies(v=make(panel)).orderBy("t").collect()]


def same(got, want, tolerance=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        if w is None or g is None:
            assert g is None and w is None, (got, want)
        elif math.isnan(w):
            assert math.isnan(g), (got, want)
        else:
            assert g == pytest.approx(w, rel=tolerance, abs=tolerance), (got, want)


def test_all_functions_are_there():
    assert (len(indicators.__all__), len(metrics.__all__), len(pnl.__all__)) == (75, 60, 18)
    for module, specs in FAMILIES.values():
        assert set(specs) == set(module.__all__)


def test_names_are_refused(spark):
    panel = Panel(frame(spark, x=[1.0]), ["k"], ["t"])
    for module, specs in FAMILIES.values():
        for name, (inputs, params) in specs.items():
            with pytest.raises(TypeError, match="expected a Spark Column"):
                getattr(module, name)(*inputs, **params, over=panel)


def test_windows_are_checked(spark):
    panel = Panel(frame(spark, x=[1.0]), ["k"], ["t"])
    for module, specs in FAMILIES.values():
        for name, (inputs, params) in specs.items():
            for key in params:
                if key.startswith("window"):
                    with pytest.raises(ValueError, match=f"{key} must be >= "):
                        getattr(module, name)(*(F.col(c) for c in inputs), **{**params, key: 0}, over=panel)
                if key == "periods_per_year":
                    with pytest.raises(ValueError, match="periods_per_year must be >= 1"):
                        getattr(module, name)(*(F.col(c) for c in inputs), **{**params, key: 0}, over=panel)


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda o: indicators.macd(F.col("x"), window_fast=5, window_slow=3, window_signal=2, over=o), "windows must be ordered window_fast <= window_slow"),
        (lambda o: indicators.parabolic_sar(F.col("x"), F.col("x"), acceleration=0.3, maximum=0.2, over=o), "acceleration must be <= maximum"),
        (lambda o: indicators.mama(F.col("x"), limit_fast=0.1, limit_slow=0.5, over=o), "limit_fast must be >= limit_slow"),
        (lambda o: indicators.variance_rolling(F.col("x"), 3, ddof=3, over=o), "ddof must be < window"),
        (lambda o: metrics.value_at_risk(F.col("x"), confidence=1.0, over=o), r"confidence must be in the open interval \(0, 1\)"),
        (lambda o: metrics.sharpe_ratio(F.col("x"), periods_per_year=252, risk_free_rate=-2.0, over=o), "risk_free_rate must be >= -1"),
        (lambda o: pnl.cost_borrow(F.col("x"), F.col("x"), rate=NAN, over=o), "rate must be a finite number >= 0"),
        (lambda o: indicators.bollinger_bands(F.col("x"), 3, multiplier=0.0, over=o), "multiplier must be a finite number > 0"),
    ],
)
def test_parameters_are_checked(spark, make, message):
    with pytest.raises(ValueError, match=message):
        make(Panel(frame(spark, x=[1.0]), ["k"], ["t"]))


def test_kernels_need_a_panel():
    from marlstone.core.over import Over

    with pytest.raises(TypeError, match="needs? |evaluate it in a Panel"):
        indicators.ema(F.col("x"), 3, over=Over(["k"], ["t"]))
    with pytest.raises(ValueError, match="an order is needed"):
        Over(["k"], [])


def test_ieee(spark):
    df = frame(spark, n=[1.0, -1.0, 0.0, 1.0, None, NAN], d=[0.0, 0.0, 0.0, -0.0, 0.0, 2.0])
    got = [r[0] for r in df.orderBy("t").select(div(F.col("n"), F.col("d"))).collect()]
    assert got[:2] == [INF, -INF] and math.isnan(got[2]) and got[3] == -INF and got[4] is None and math.isnan(got[5])
    got = [r[0] for r in frame(spark, x=[0.0, -1.0, 1.0, None]).orderBy("t").select(ln(F.col("x"))).collect()]
    assert got[0] == -INF and math.isnan(got[1]) and got[2] == 0.0 and got[3] is None
    from statistics import NormalDist

    points = [-38.0, -8.0, -3.5, -3.0, -1.0, 0.0, 0.7, 2.9, 3.1, 9.0, INF, -INF]
    got = [r[0] for r in frame(spark, x=points).orderBy("t").select(normal_cdf(F.col("x"))).collect()]
    for g, x in zip(got, points, strict=True):
        assert g == pytest.approx(NormalDist().cdf(x) if math.isfinite(x) else float(x > 0), rel=1e-11, abs=1e-15)


def test_known_values_of_a_closed_form_series(spark):
    """Published results for the last of 400 bars."""
    close = [100 + 10 * math.sin(i / 9) + 4 * math.cos(i / 23) + 0.03 * i for i in range(400)]
    high = [c + 0.6 + 0.4 * abs(math.sin(i / 5)) for i, c in enumerate(close)]
    low = [c - 0.6 - 0.4 * abs(math.cos(i / 7)) for i, c in enumerate(close)]
    panel = Panel(frame(spark, high=high, low=low, close=close), ["k"], ["t"])
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    out = panel.with_studies(
        sma=indicators.sma(c, 20, over=panel), ema=indicators.ema(c, 20, over=panel), rsi=indicators.rsi(c, 14, over=panel),
        atr=indicators.atr(h, l, c, 14, over=panel), macd=indicators.macd(c, window_fast=12, window_slow=26, window_signal=9, over=panel)["macd"],
    )
    last = out.orderBy(F.col("t").desc()).first()
    want = {"sma": 105.15146076264764, "ema": 107.7299930892346, "rsi": 85.20908701341023, "atr": 1.904174462198776, "macd": 2.523444380829531}
    for name, value in want.items():
        assert last[name] == pytest.approx(value, rel=1e-10)


def test_cci(spark):
    """Against the definition, bar by bar; a flat window has no deviation to divide by."""
    rng = random.Random(4)
    mid = [50.0 + rng.gauss(0, 2) for _ in range(25)] + [50.0] * 6
    high, low, close = [m + rng.random() * (k < 25) for k, m in enumerate(mid)], [m - rng.random() * (k < 25) for k, m in enumerate(mid)], mid
    typical, want = [(h + l + c) / 3 for h, l, c in zip(high, low, close, strict=True)], []
    for k in range(len(mid)):
        if k < 4:
            want.append(None)
            continue
        span = typical[k - 4 : k + 1]
        mean = sum(span) / 5
        spread = sum(abs(x - mean) for x in span) / 5
        want.append((typical[k] - mean) / (0.015 * spread) if max(span) > min(span) else math.nan)
    got = study(spark, lambda o: indicators.cci(F.col("high"), F.col("low"), F.col("close"), 5, over=o), high=high, low=low, close=close)
    same(got[:28], want[:28], 1e-8)
    assert got[-1] is not None


def test_panels_have_one_order(spark):
    """A null order comes first for windows and kernels alike; names are checked, and may hold dots."""
    df = spark.createDataFrame([("a", 1, 2.0, 0.0), ("a", None, 1.0, 0.0), ("a", 2, 4.0, 0.0), ("b", 1, 8.0, 0.0)], "`the.key` string, `t.t` long, close double, `x.y` double")
    panel = Panel(df, ["the.key"], ["t.t"])
    out = panel.with_studies(slow=indicators.sma(F.col("close"), 2, over=panel), fast=indicators.ema(F.col("close"), 2, over=panel))
    rows = {(r["the.key"], r["t.t"]): (r["slow"], r["fast"]) for r in out.collect()}
    assert out.columns == ["the.key", "t.t", "close", "x.y", "slow", "fast"]
    assert rows["a", None] == (None, None) and rows["a", 1] == (1.5, 1.5) and rows["a", 2] == (3.0, pytest.approx(4 * 2 / 3 + 1.5 / 3))
    worst = panel.metrics(worst=metrics.max_drawdown(F.col("close"), over=panel))
    assert worst.columns == ["the.key", "worst"] and panel.with_metrics(worst=metrics.max_drawdown(F.col("close"), over=panel)).count() == 4
    for make in (lambda: Panel(df, ["the.key"], [F.col("close")]), lambda: Panel(df, [F.lit(1)], ["close"])):
        with pytest.raises(TypeError, match="column names"):
            make()
    with pytest.raises(ValueError, match="no column"):
        Panel(df, ["none"], ["close"])
    with pytest.raises(ValueError, match="already"):
        panel.with_studies(Close=indicators.sma(F.col("close"), 2, over=panel))


def test_slopes_of_large_means(spark):
    """Rolling beta keeps its digits where means dwarf the spread, and passes NaN and null on."""
    rng = random.Random(6)
    b = [1e6 + rng.gauss(0, 1) for _ in range(30)]
    r = [1e6 + 0.5 * (x - 1e6) for x in b]
    b[3], r[8], b[20] = math.nan, None, None
    got = study(spark, lambda o: metrics.beta_rolling(F.col("r"), F.col("b"), 4, over=o), r=r, b=b)
    for k in range(30):
        span = range(k - 3, k + 1)
        if k < 3 or any(r[i] is None or b[i] is None for i in span):
            assert got[k] is None
        elif any(math.isnan(b[i]) or math.isnan(r[i]) for i in span):
            assert math.isnan(got[k])
        else:
            assert got[k] == pytest.approx(0.5, rel=1e-8)


def test_captures_by_hand(spark):
    r, b = [0.02, -0.01, 0.03, None, 0.01, -0.05], [0.01, -0.02, 0.02, 0.5, None, -0.03]
    df = frame(spark, r=r, b=b)
    got = df.agg(*(getattr(metrics, f"capture_{n}ratio")(F.col("r"), F.col("b"), periods_per_year=12).alias(n or "all") for n in ("upside_", "downside_", ""))).first()
    up = ((1.02 * 1.03) ** 6 - 1) / ((1.01 * 1.02) ** 6 - 1)
    down = ((0.99 * 0.95) ** 6 - 1) / ((0.98 * 0.97) ** 6 - 1)
    assert tuple(got) == pytest.approx((up, down, up / down), rel=1e-12)
    ratio = lambda r, b, up=True: frame(spark, r=r, b=b).agg(getattr(metrics, f"capture_{'up' if up else 'down'}side_ratio")(F.col("r"), F.col("b"), periods_per_year=12)).first()[0]
    assert ratio([0.1], [-0.1]) is None and math.isnan(ratio([-1.0], [0.1])) and math.isnan(ratio([NAN], [0.1])) and math.isnan(ratio([0.1], [-1.5], False))


def test_parameters_against_definitions(spark):
    """Variants that the SQL twins don't reach: adjusted means, biased variances, ddof, windows of one."""
    rng = random.Random(5)
    x = [10 + rng.gauss(0, 1) for _ in range(40)]
    x[7], x[19] = None, None
    seen = lambda k: [(j, v) for j, v in enumerate(x[: k + 1]) if v is not None]
    alpha = 2 / 6
    panel = Panel(frame(spark, x=x), ["k"], ["t"])
    c = F.col("x")
    out = panel.with_studies(
        adjusted=indicators.ema(c, 5, adjust=True, over=panel), biased=indicators.variance_ewma(c, 5, adjust=True, bias=True, over=panel),
        unbiased=indicators.variance_ewma(c, 5, adjust=True, bias=False, over=panel), population=indicators.variance_rolling(c, 4, ddof=0, over=panel),
        two=indicators.variance_rolling(c, 4, ddof=2, over=panel), one=indicators.sma(c, 1, over=panel),
    )
    rows = out.orderBy("t").collect()
    for k, r in enumerate(rows):
        assert r["one"] == x[k]
        span = x[max(0, k - 3) : k + 1]
        if k >= 3 and None not in span:
            mean = sum(span) / 4
            squares = sum((v - mean) ** 2 for v in span)
            assert r["population"] == pytest.approx(squares / 4, rel=1e-10) and r["two"] == pytest.approx(squares / 2, rel=1e-10)
        else:
            assert r["population"] is None and r["two"] is None
        if x[k] is None or len(seen(k)) < 5:
            assert r["adjusted"] is None
            continue
        w = [(1 - alpha) ** (k - j) for j, _ in seen(k)]
        mean = sum(a * v for a, (_, v) in zip(w, seen(k), strict=True)) / sum(w)
        assert r["adjusted"] == pytest.approx(mean, rel=1e-10)
        spread = sum(a * (v - mean) ** 2 for a, (_, v) in zip(w, seen(k), strict=True)) / sum(w)
        assert r["biased"] == pytest.approx(spread, rel=1e-9)
        assert r["unbiased"] == pytest.approx(spread * sum(w) ** 2 / (sum(w) ** 2 - sum(a * a for a in w)), rel=1e-9)


def test_cycle_of_sines_flats_and_walks():
    """Waves of a known period are measured as such, their phase turns once a cycle, what is beyond a gap is null."""
    from marlstone.operators.kernels import CYCLE, cycle

    for length in (12, 20, 30):
        lanes = dict(zip(CYCLE, cycle([100 + 5 * math.sin(2 * math.pi * i / length) for i in range(600)], fast=0.5, slow=0.05), strict=True))
        assert abs(lanes["period"][-1] - length) < 0.1 * length
        turns = sum(b < a - 180 for a, b in zip(lanes["phase"][300:-1], lanes["phase"][301:], strict=True))
        assert abs(turns - 299 / length) <= 1.5
        assert abs(sum(lanes["trendline"][-length * 5 :]) / (length * 5) - 100) < 1 and max(map(abs, lanes["sine"][100:])) <= 1
    rng, x, walk = random.Random(2), 100.0, []
    for _ in range(300):
        x += rng.gauss(0, 1)
        walk.append(x)
    whole, cut = cycle(walk, fast=0.5, slow=0.05), cycle([*walk[:200], None, *walk[200:]], fast=0.5, slow=0.05)
    for name, a, b in zip(CYCLE, whole, cut, strict=True):
        assert b[:200] == pytest.approx(a[:200], rel=1e-12) if name not in () and None not in b[:200] else [v for v in b[:200] if v is not None] == pytest.approx([v for v in a[:200] if v is not None], rel=1e-12)
        assert b[200:] == [None] * 101
    flat = dict(zip(CYCLE, cycle([7.0] * 100, fast=0.5, slow=0.05), strict=True))
    assert flat["trendline"][-1] == pytest.approx(7.0) and flat["mama"][-1] == pytest.approx(7.0) and flat["in_phase"][-1] == pytest.approx(0.0, abs=1e-9)
    assert all(lane == [None] * 9 for lane in cycle([1.0] * 9, fast=0.5, slow=0.05)) and all(lane == [] for lane in cycle([], fast=0.5, slow=0.05))


def naive_mean(x, alpha, n):
    out, mean, weight, seeds = [], None, 1.0, []
    for v in x:
        if mean is not None:
            weight *= 1 - alpha
        if v is None:
            out.append(None)
        elif mean is None:
            seeds.append(v)
            mean = sum(seeds) / n if len(seeds) == n else None
            out.append(mean)
        else:
            mean, weight = (weight * mean + alpha * v) / (weight + alpha), 1.0
            out.append(mean)
    return out


def test_recursive_mean_bridges_nulls_and_keeps_nan(spark):
    x = [None, 1.0, 4.0, None, 2.0, 5.0, None, None, 3.0, 8.0]
    same(study(spark, lambda o: indicators.ema(F.col("x"), 3, over=o), x=x), naive_mean(x, 0.5, 3))
    same(study(spark, lambda o: indicators.rma(F.col("x"), 3, over=o), x=x), naive_mean(x, 1 / 3, 3))
    long = [math.sin(i) + i / 50 for i in range(1000)]
    same(study(spark, lambda o: indicators.ema(F.col("x"), 20, over=o), x=long), naive_mean(long, 2 / 21, 20), 1e-12)
    got = study(spark, lambda o: indicators.ema(F.col("x"), 2, over=o), x=[1.0, 2.0, NAN, 3.0, None, 4.0])
    assert got[0] is None and got[1] == 1.5 and math.isnan(got[2]) and math.isnan(got[3]) and got[4] is None and math.isnan(got[5])


def test_chained_kernels(spark):
    x = [math.sin(i / 3) * 5 + 100 for i in range(60)]
    one = naive_mean(x, 0.5, 3)
    two = naive_mean(one, 0.5, 3)
    same(study(spark, lambda o: indicators.dema(F.col("x"), 3, over=o), x=x), [None if b is None else 2 * a - b for a, b in zip(one, two, strict=True)])
    got = study(spark, lambda o: indicators.t3(F.col("x"), 3, over=o), x=x)
    assert [v is None for v in got].index(False) == 12


def test_a_pass_serves_many_studies(spark):
    panel = Panel(frame(spark, x=[float(i % 7) for i in range(50)]), ["k"], ["t"])
    x = F.col("x")
    out = panel.with_studies(a=indicators.ema(x, 3, over=panel), b=indicators.ema(x, 3, over=panel), c=indicators.t3(x, 3, over=panel), d=indicators.rsi(x, 5, over=panel))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    assert all(r["a"] == r["b"] for r in out.collect())


def test_windows_with_nulls_and_nan(spark):
    x = [1.0, None, 3.0, 4.0, NAN, 6.0, 7.0, 8.0]
    same(study(spark, lambda o: indicators.sma(F.col("x"), 2, over=o), x=x), [None, None, None, 3.5, NAN, NAN, 6.5, 7.5])
    same(study(spark, lambda o: indicators.midpoint(F.col("x"), 2, over=o), x=x), [None, None, None, 3.5, NAN, NAN, 6.5, 7.5])
    same(study(spark, lambda o: indicators.variance_rolling(F.col("x"), 2, over=o), x=[0.1, 0.1, 0.1, NAN, 1.0, 2.0]), [None, 0.0, 0.0, NAN, NAN, 0.25])


def test_running_values(spark):
    x = [0.1, None, -0.5, NAN, 0.2]
    same(study(spark, lambda o: pnl.cumulative_pnl(F.col("x"), over=o), x=x), [0.1, None, -0.4, NAN, NAN])
    same(study(spark, lambda o: pnl.equity_curve(F.col("x"), over=o), x=x), [1.1, None, 0.55, NAN, NAN])
    same(study(spark, lambda o: pnl.turnover(F.col("x"), over=o), x=[0.5, -0.5, None, 1.0]), [0.5, 1.0, None, None])
    same(study(spark, lambda o: metrics.drawdown(F.col("x"), over=o), x=[1.0, 2.0, NAN, 1.0, None, 3.0]), [0.0, 0.0, NAN, -0.5, None, 0.0])


def reduce(spark, make, **lanes):
    panel = Panel(frame(spark, **lanes), ["k"], ["t"])
    return panel.metrics(v=make(panel)).first()["v"]


def test_reducers(spark):
    x = F.col("x")
    r = [0.01, None, -0.02, 0.03, 0.0]
    assert reduce(spark, lambda o: metrics.win_rate(x, over=o), x=r) == pytest.approx(2 / 3)
    assert reduce(spark, lambda o: metrics.volatility(x, periods_per_year=4, over=o), x=[0.01, 0.01, 0.01]) == 0.0
    assert reduce(spark, lambda o: metrics.sharpe_ratio(x, periods_per_year=4, over=o), x=[0.01, 0.01]) == INF
    assert math.isnan(reduce(spark, lambda o: metrics.sharpe_ratio(x, periods_per_year=4, over=o), x=[0.01, NAN]))
    assert reduce(spark, lambda o: metrics.max_drawdown(x, over=o), x=[1.0, 2.0, 1.0, None, 3.0]) == -0.5
    assert reduce(spark, lambda o: metrics.max_drawdown_duration(x, over=o), x=[1.0, 0.9, None, 0.8, 1.0, 0.5]) == 2.0
    assert reduce(spark, lambda o: metrics.total_return(x, over=o), x=[1.0, 1.5, None]) == 0.5
    # Half of four values is two: the mean of the two worst.
    assert reduce(spark, lambda o: metrics.conditional_value_at_risk(x, confidence=0.5, over=o), x=[-0.2, 0.1, -0.1, 0.3]) == pytest.approx(-0.15)
    assert reduce(spark, lambda o: metrics.skewness(x, over=o), x=[1.0, 2.0, 5.0]) == pytest.approx(0.5280049792181878)
    for name in ("value_at_risk", "tail_ratio", "skewness", "stability", "win_rate"):
        assert reduce(spark, lambda o, name=name: getattr(metrics, name)(x, over=o), x=[None, None]) is None


def test_pairs_are_complete(spark):
    x, y = F.col("x"), F.col("y")
    lanes = {"x": [0.01, None, 0.03, -0.01], "y": [0.02, 0.5, 0.01, None]}
    pairs = [(0.01, 0.02), (0.03, 0.01)]
    mx, my = (sum(p[i] for p in pairs) / 2 for i in (0, 1))
    want = sum((a - mx) * (b - my) for a, b in pairs) / sum((b - my) ** 2 for _, b in pairs)
    assert reduce(spark, lambda o: metrics.beta(x, y, over=o), **lanes) == pytest.approx(want)
    assert reduce(spark, lambda o: metrics.beta(x, y, over=o), x=[0.1, None], y=[0.1, 0.2]) is None


def test_empty_and_single(spark):
    schema = "k long, t long, " + ", ".join(f"{c} double" for c in ("open", "high", "low", "close", "volume", "returns", "benchmark", "equity_curve", "weight", "quantity", "cost", "dividend_per_share", "funding_rate"))
    empty = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(0, 0, *[1.0] * 13)], schema)
    for df, rows in ((empty, 0), (one, 1)):
        for family, (module, specs) in FAMILIES.items():
            panel, studies, reducers = Panel(df, ["k"], ["t"]), {}, {}
            for name, (inputs, params) in specs.items():
                column = getattr(module, name)(*(F.col(c) for c in inputs), **params, over=panel)
                (reducers if is_reducing(family, name) else studies)[f"v_{name}"] = column
            assert len(panel.with_studies(**studies).collect()) == rows
            if reducers:
                assert len(panel.metrics(**reducers).collect()) == rows


def test_series_do_not_leak(spark):
    schema = "k long, t long, x double"
    df = spark.createDataFrame([(k, t, float(k * 100 + t)) for k in (1, 2) for t in range(6)], schema)
    panel = Panel(df, ["k"], ["t"])
    out = panel.with_studies(a=indicators.sma(F.col("x"), 3, over=panel), b=indicators.ema(F.col("x"), 3, over=panel), c=pnl.returns_simple(F.col("x"), over=panel))
    for r in out.where("t < 2").collect():
        assert r["a"] is None and r["b"] is None and (r["t"] or r["c"] is None)
    wide = panel.with_metrics(total=metrics.total_return(F.col("x"), over=panel))
    assert {r["k"]: r["total"] for r in wide.collect()} == {1: 104.0, 2: 204.0}


def test_signatures_are_uniform():
    for module in MODULES:
        for name in module.__all__:
            assert inspect.signature(getattr(module, name)).parameters["over"].kind is inspect.Parameter.KEYWORD_ONLY


def test_cycle_studies_of_a_wave(spark):
    """What the measurement gives for the last of 200 bars of a wave of 20."""
    close = [100.0 + math.sin(2 * math.pi * i / 20) for i in range(200)]
    panel = Panel(frame(spark, close=close), ["k"], ["t"])
    c = F.col("close")
    out = panel.with_studies(
        period=indicators.dominant_cycle_period(c, over=panel), phase=indicators.dominant_cycle_phase(c, over=panel), wave=indicators.sine_wave(c, over=panel),
        trend=indicators.hilbert_trendline(c, over=panel), mama=indicators.mama(c, over=panel), phasor=indicators.hilbert_phasor(c, over=panel),
        mode=indicators.trend_mode(c, over=panel),
    )
    rows = out.orderBy("t").collect()
    last = rows[-1]
    got = [last["period"], last["phase"], *last["wave"], last["trend"], *last["mama"], *last["phasor"]]
    assert [round(v, 2) for v in got] == [20.03, -17.84, -0.31, 0.46, 100.0, 99.67, 99.96, -0.8, 0.61]
    assert {r["mode"] for r in rows} == {None, 0.0}
    first = {n: next(r["t"] for r in rows if (r[n][0] if isinstance(r[n], tuple) else r[n]) is not None) for n in ("period", "phase", "wave", "trend", "mama", "phasor", "mode")}
    assert first == {"period": 32, "phase": 63, "wave": 63, "trend": 63, "mama": 32, "phasor": 32, "mode": 63}
    gap = Panel(frame(spark, close=[*close[:100], None, *close[101:]]), ["k"], ["t"])
    cut = [r["v"] for r in gap.with_studies(v=indicators.dominant_cycle_period(c, over=gap)).orderBy("t").collect()]
    assert cut[:100] == [r["period"] for r in rows[:100]] and cut[100:] == [None] * 100
