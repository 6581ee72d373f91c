"""Equivalent SQL (DuckDB) of the queries, written apart from the Column functions.

Stages of common table expressions over a ``market`` base; recursions of exponential means are
written as explicit weighted sums over the past, state machines as recursive queries.
"""

from __future__ import annotations

from .queries import DIGITS, FAMILIES, NUDGE

BASE = """ev AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar, 100.0::DOUBLE + value / 10.0 AS p, ts, event_id FROM events),
ohlc AS (SELECT symbol, bar, first(p ORDER BY ts, event_id) AS o, max(p) AS h, min(p) AS l, last(p ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v FROM ev GROUP BY symbol, bar),
num AS (SELECT *, row_number() OVER w AS t, c / lag(c) OVER w - 1 AS r FROM ohlc WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
ben AS (SELECT bar, avg(r) AS b FROM num GROUP BY bar),
s0 AS (SELECT symbol, t, o, h, l, c, v, r, b, CASE WHEN r IS NOT NULL THEN product(1 + r) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) END AS e,
  (t % 7) / 3.0::DOUBLE - 1 AS w, (t % 5) * 10.0::DOUBLE - 20 AS q, (t % 3) * 0.001::DOUBLE AS k, 0.05::DOUBLE AS d, 0.0001::DOUBLE AS f FROM num JOIN ben USING (bar))"""

ROWS = "OVER (PARTITION BY symbol ORDER BY t)"
RUN = "OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)"
NAN = "'nan'::DOUBLE"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(aggregate: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN {aggregate.format(x)} {over(n)} END)"


def mean(x: str, n: int) -> str:
    return roll("avg({})", x, n)


def total(x: str, n: int) -> str:
    return roll("sum({})", x, n)


def top(x: str, n: int) -> str:
    return roll("max({})", x, n)


def low(x: str, n: int) -> str:
    return roll("min({})", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) {ROWS})"


class Query:
    def __init__(self) -> None:
        self.parts, self.n = [BASE], 0

    @property
    def at(self) -> str:
        return f"s{self.n}"

    def let(self, **columns: str) -> Query:
        before = self.at
        self.n += 1
        self.parts.append(f"{self.at} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM {before})")
        return self

    def smooth(self, name: str, x: str, alpha: float, n: int) -> Query:
        """Exponential mean of ``x`` (nulls at the start only), seeded with the mean of n values."""
        before = self.at
        self.n += 1
        i, a = self.n, repr(alpha)
        self.parts += [
            f"c{i} AS (SELECT symbol, t, {x} AS x, count({x}) {RUN} AS k FROM {before})",
            f"d{i} AS (SELECT symbol, min(t) FILTER (k = {n}) AS t0, avg(x) FILTER (k <= {n}) AS seed FROM c{i} WHERE x IS NOT NULL GROUP BY symbol)",
            f"e{i} AS (SELECT a.symbol, a.t, sum({a} * pow(1 - {a}, a.t - z.t) * z.x) AS y FROM c{i} a JOIN d{i} d ON a.symbol = d.symbol JOIN c{i} z ON z.symbol = a.symbol AND z.t <= a.t AND z.t > d.t0 GROUP BY a.symbol, a.t)",
            f"s{i} AS (SELECT a.*, CASE WHEN a.t >= d.t0 THEN pow(1 - {a}, a.t - d.t0) * d.seed + coalesce(e.y, 0) END AS {name} FROM {before} a LEFT JOIN d{i} d USING (symbol) LEFT JOIN e{i} e USING (symbol, t))",
        ]
        return self

    def ema(self, name: str, x: str, n: int) -> Query:
        return self.smooth(name, x, 2.0 / (n + 1), n)

    def rma(self, name: str, x: str, n: int) -> Query:
        return self.smooth(name, x, 1.0 / n, n)

    def recursive(self, columns: str, seed: str, step: str) -> Query:
        """A state a row: ``seed`` selects symbol, t and state, ``step`` the next from k and row z."""
        before = self.at
        self.n += 1
        i = self.n
        names = ", ".join(f"g{i}.{c.strip()}" for c in columns.split(","))
        self.parts.append(f"g{i}(symbol, t, {columns}) AS ({seed.format(before)} UNION ALL SELECT z.symbol, z.t, {step} FROM g{i} k JOIN {before} z ON z.symbol = k.symbol AND z.t = k.t + 1)")
        self.parts.append(f"s{i} AS (SELECT a.*, {names} FROM {before} a LEFT JOIN g{i} USING (symbol, t))")
        return self

    def rows(self, **out: str) -> str:
        lanes = ", ".join(f"round({x} + {NUDGE}, {DIGITS}) AS {k}" for k, x in out.items())
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT symbol, t, {lanes} FROM {self.at}"

    def groups(self, value: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT symbol, round({value} + {NUDGE}, {DIGITS}) AS value FROM {self.at} GROUP BY symbol"


def _values(**plain: str) -> dict[str, str]:
    return {k: Query().rows(value=x) for k, x in plain.items()}


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n)) + f") / {n * (n + 1) / 2}"


def _slope(x: str, n: int) -> str:
    return "((" + " + ".join(f"({(n - 1) / 2 - k}) * {lag(x, k) if k else x}" for k in range(n)) + f") / {n * (n * n - 1) / 12})"


_TR = f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"
_UP, _DOWN = f"(h - {lag('h')})", f"({lag('l')} - l)"
_PLUS = f"CASE WHEN {_UP} > {_DOWN} AND {_UP} > 0 THEN {_UP} ELSE 0 END"
_MINUS = f"CASE WHEN {_DOWN} > {_UP} AND {_DOWN} > 0 THEN {_DOWN} ELSE 0 END"
_TYPICAL = "((h + l + c) / 3)"
_FLOW = "(CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) END * v)"


def _indicators() -> dict[str, str]:
    q = Query
    out = _values(
        accumulation_distribution=f"sum({_FLOW}) {RUN}",
        awesome_oscillator=f"{mean('(h + l) / 2', 5)} - {mean('(h + l) / 2', 34)}",
        balance_of_power="CASE WHEN h = l THEN 0 ELSE (c - o) / (h - l) END",
        linear_regression=f"{mean('c', 14)} + {_slope('c', 14)} * 6.5",
        linear_regression_angle=f"degrees(atan({_slope('c', 14)}))",
        linear_regression_intercept=f"{mean('c', 14)} - {_slope('c', 14)} * 6.5",
        linear_regression_slope=_slope("c", 14),
        midpoint=f"({top('c', 14)} + {low('c', 14)}) / 2",
        midprice=f"({top('h', 14)} + {low('l', 14)}) / 2",
        mom=f"c - {lag('c', 10)}",
        price_average="(o + h + l + c) / 4",
        price_median="(h + l) / 2",
        price_typical=_TYPICAL,
        price_weighted_close="(h + l + 2 * c) / 4",
        roc=f"100 * (c - {lag('c', 10)}) / {lag('c', 10)}",
        sma=mean("c", 20),
        standard_deviation_rolling=roll("stddev_pop({})", "c", 14),
        time_series_forecast=f"{mean('c', 14)} + {_slope('c', 14)} * 7.5",
        true_range=_TR,
        variance_rolling=roll("var_samp({})", "c", 14),
        vwap=f"sum({_TYPICAL} * v) {RUN} / sum(v) {RUN}",
        vwma=f"{total('c * v', 20)} / {total('v', 20)}",
        williams_r=f"-100 * ({top('h', 14)} - c) / ({top('h', 14)} - {low('l', 14)})",
        wma=_wma("c", 10),
    )
    out["obv"] = q().let(d1=f"c - {lag('c')}").rows(value=f"sum(coalesce(sign(d1), 0) * v) {RUN}")
    out["absolute_price_oscillator"] = q().ema("a", "c", 12).ema("z", "c", 26).rows(value="a - z")
    out["percentage_price_oscillator"] = q().ema("a", "c", 12).ema("z", "c", 26).rows(value="(a - z) / z * 100")
    out["accumulation_distribution_oscillator"] = q().let(ad=f"sum({_FLOW}) {RUN}").ema("a", "ad", 3).ema("z", "ad", 10).rows(value="a - z")
    dm = lambda: q().let(tr=_TR, p=_PLUS, m=_MINUS).rma("atr", "tr", 14).rma("dp", "p", 14).rma("dn", "m", 14)
    dx = "100 * abs(100 * dp / atr - 100 * dn / atr) / (100 * dp / atr + 100 * dn / atr)"
    out["atr"] = q().let(tr=_TR).rma("a", "tr", 14).rows(value="a")
    out["atr_normalized"] = q().let(tr=_TR).rma("a", "tr", 14).rows(value="100 * a / c")
    out["dm_plus"], out["dm_minus"] = (q().let(x=x).rma("a", "x", 14).rows(value="a") for x in (_PLUS, _MINUS))
    out["di_plus"], out["di_minus"], out["dx"] = dm().rows(value="100 * dp / atr"), dm().rows(value="100 * dn / atr"), dm().rows(value=dx)
    out["adx"] = dm().let(dx=dx).rma("a", "dx", 14).rows(value="a")
    out["adxr"] = dm().let(dx=dx).rma("a", "dx", 14).rows(value=f"(a + {lag('a', 14)}) / 2")
    since = lambda x, f, order: f"(CASE WHEN count({x}) {over(26)} = 26 THEN 100 * (25 - (t - {f}(t, {x} {order}) {over(26)})) / 25.0 END)"
    for name, ends in {"aroon": ("up", "down"), "aroon_oscillator": None}.items():
        up, down = since("h", "arg_max", "+ t * 1e-12"), since("l", "arg_min", "- t * 1e-12")
        out[name] = q().rows(up=up, down=down) if ends else q().rows(value=f"{up} - {down}")
    out["bollinger_bands"] = q().let(m=mean("c", 20), s=roll("stddev_pop({})", "c", 20)).rows(lower="m - 2 * s", middle="m", upper="m + 2 * s")
    out["cci"] = q().let(tp=_TYPICAL).let(m=mean("tp", 20), xs=f"list(tp) {over(20)}").rows(value="CASE WHEN m IS NOT NULL THEN (tp - m) / (0.015 * list_avg(list_transform(xs, lambda x: abs(x - m)))) END")
    out["chaikin_money_flow"] = q().let(mf=_FLOW).rows(value=f"{total('mf', 20)} / {total('v', 20)}")
    out["chande_momentum_oscillator"] = q().let(x=f"c - {lag('c')}").let(g="CASE WHEN x > 0 THEN x WHEN x IS NOT NULL THEN 0 END", s="CASE WHEN x < 0 THEN -x WHEN x IS NOT NULL THEN 0 END").rows(value=f"100 * ({total('g', 14)} - {total('s', 14)}) / ({total('g', 14)} + {total('s', 14)})")
    out["dema"] = q().ema("a", "c", 10).ema("z", "a", 10).rows(value="2 * a - z")
    out["tema"] = q().ema("a", "c", 10).ema("y", "a", 10).ema("z", "y", 10).rows(value="3 * a - 3 * y + z")
    t3 = q().ema("e1", "c", 5)
    for i in range(2, 7):
        t3.ema(f"e{i}", f"e{i - 1}", 5)
    out["t3"] = t3.rows(value="-0.343 * e6 + (3 * 0.49 + 3 * 0.343) * e5 + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4 + (1 + 3 * 0.7 + 3 * 0.49 + 0.343) * e3")
    out["trix"] = q().ema("a", "c", 10).ema("y", "a", 10).ema("z", "y", 10).rows(value=f"100 * (z - {lag('z')}) / {lag('z')}")
    out["ema"], out["rma"] = q().ema("a", "c", 20).rows(value="a"), q().rma("a", "c", 14).rows(value="a")
    out["macd"] = q().ema("a", "c", 12).ema("z", "c", 26).let(m="a - z").ema("s", "m", 9).rows(macd="m", signal="s", histogram="m - s")
    out["donchian_channels"] = q().let(hi=top("h", 20), lo=low("l", 20)).rows(lower="lo", middle="(hi + lo) / 2", upper="hi")
    mid = lambda n: f"({top('h', n)} + {low('l', n)}) / 2"
    out["ichimoku"] = q().let(a=mid(9), z=mid(26), y=mid(52)).rows(tenkan="a", kijun="z", senkou_a="(a + z) / 2", senkou_b="y")
    out["hma"] = q().let(x=f"2 * {_wma('c', 8)} - {_wma('c', 16)}").rows(value=_wma("x", 4))
    out["keltner_channels"] = q().let(tr=_TR).ema("m", "c", 20).rma("a", "tr", 10).rows(lower="m - 2 * a", middle="m", upper="m + 2 * a")
    gain, loss = "CASE WHEN x > 0 THEN x WHEN x IS NOT NULL THEN 0 END", "CASE WHEN x < 0 THEN -x WHEN x IS NOT NULL THEN 0 END"
    rsi = lambda: q().let(x=f"c - {lag('c')}").let(g=gain, s=loss).rma("ag", "g", 14).rma("al", "s", 14)
    out["rsi"] = rsi().rows(value="100 - 100 / (1 + ag / al)")
    rs = rsi().let(rs="100 - 100 / (1 + ag / al)").let(kk=f"100 * (rs - {low('rs', 14)}) / ({top('rs', 14)} - {low('rs', 14)})")
    out["rsi_stochastic"] = rs.rows(k="kk", d=mean("kk", 3))
    raw = f"100 * (c - {low('l', 14)}) / ({top('h', 14)} - {low('l', 14)})"
    out["stochastic_fast"] = q().let(kk=raw).rows(k="kk", d=mean("kk", 3))
    out["stochastic_slow"] = q().let(kk=raw).let(ks=mean("kk", 3)).rows(k="ks", d=mean("ks", 3))
    mfi = q().let(tp=_TYPICAL).let(x=f"tp - {lag('tp')}").let(p="CASE WHEN x > 0 THEN tp * v WHEN x <= 0 THEN 0 END", n="CASE WHEN x < 0 THEN tp * v WHEN x >= 0 THEN 0 END")
    out["money_flow_index"] = mfi.rows(value=f"100 - 100 / (1 + {total('p', 14)} / {total('n', 14)})")
    out["trima"] = q().let(x=mean("c", 5)).rows(value=mean("x", 6))
    uo = q().let(pc=lag("c")).let(lo="least(l, pc)", hi="greatest(h, pc)").let(bp="CASE WHEN pc IS NOT NULL OR l IS NOT NULL THEN c - lo END", tr="hi - lo")
    out["ultimate_oscillator"] = uo.rows(value="100 * (" + " + ".join(f"{k} * {total('bp', n)} / {total('tr', n)}" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7")
    out["vortex"] = q().let(tr=_TR, p=f"abs(h - {lag('l')})", m=f"abs(l - {lag('h')})").rows(plus=f"{total('p', 14)} / {total('tr', 14)}", minus=f"{total('m', 14)} / {total('tr', 14)}")
    a = 2.0 / 15
    weights = f"(CASE WHEN z.t = 1 THEN pow({1 - a!r}, a.t - 1) ELSE {a!r} * pow({1 - a!r}, a.t - z.t) END)"
    ewm = q()
    ewm.parts += [
        f"em AS (SELECT a.symbol, a.t, sum({weights} * z.c) AS m FROM s0 a JOIN s0 z ON z.symbol = a.symbol AND z.t <= a.t GROUP BY a.symbol, a.t)",
        f"s1 AS (SELECT a.symbol, a.t, CASE WHEN a.t >= 14 THEN sum({weights} * (z.c - a.m) * (z.c - a.m)) END AS x FROM em a JOIN s0 z ON z.symbol = a.symbol AND z.t <= a.t GROUP BY a.symbol, a.t)",
    ]
    ewm.n = 1
    out["variance_ewma"], out["standard_deviation_ewma"] = ewm.rows(value="x"), ewm.rows(value="sqrt(x)")
    sc = q().let(x=f"abs(c - {lag('c')})").let(g=total("x", 10)).let(sp=f"pow((CASE WHEN g = 0 THEN 0 ELSE abs(c - {lag('c', 10)}) / g END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)")
    sc.recursive("y", "SELECT symbol, t, c FROM {} WHERE t = 10", "k.y + z.sp * (z.c - k.y)")
    out["kama"] = sc.rows(value="y")
    ft = q().let(m="(h + l) / 2").let(p=f"2 * (m - {low('m', 10)}) / ({top('m', 10)} - {low('m', 10)}) - 1")
    clamp = "greatest(-0.999, least(0.999, 0.33 * {0}.p + 0.67 * {1}))"
    first, then = clamp.format("z", "0.0"), clamp.format("z", "k.sm")
    ft.recursive("sm, y", f"SELECT symbol, t, {first}, 0.5 * ln((1 + {first}) / (1 - {first})) FROM {{}} z WHERE t = 10", f"{then}, 0.5 * ln((1 + {then}) / (1 - {then})) + 0.5 * k.y")
    out["fisher_transform"] = ft.rows(fisher="y", signal=lag("y"))
    st = q().let(tr=_TR).rma("a", "tr", 10).let(u="(h + l) / 2 + 3 * a", d9="(h + l) / 2 - 3 * a")
    tb, bb = "CASE WHEN z.u < k.tb OR k.pc > k.tb THEN z.u ELSE k.tb END", "CASE WHEN z.d9 > k.bb OR k.pc < k.bb THEN z.d9 ELSE k.bb END"
    side = f"CASE WHEN k.side > 0 THEN (CASE WHEN z.c < ({bb}) THEN -1.0 ELSE 1.0 END) ELSE (CASE WHEN z.c > ({tb}) THEN 1.0 ELSE -1.0 END) END"
    st.recursive("tb, bb, side, pc", "SELECT symbol, t, u, d9, (CASE WHEN c <= d9 THEN -1.0 ELSE 1.0 END)::DOUBLE, c FROM {} WHERE t = 10", f"{tb}, {bb}, ({side})::DOUBLE, z.c")
    out["supertrend"] = st.rows(line="CASE WHEN side < 0 THEN tb WHEN side > 0 THEN bb END", direction="side")
    sar = q().let(h1=lag("h"), h2=lag("h", 2), l1=lag("l"), l2=lag("l", 2))
    stop = "(CASE WHEN k.side > 0 THEN least(k.stop + k.af * (k.ep - k.stop), z.l1, z.l2) ELSE greatest(k.stop + k.af * (k.ep - k.stop), z.h1, z.h2) END)"
    ep = "(CASE WHEN k.side > 0 THEN greatest(k.ep, z.h) ELSE least(k.ep, z.l) END)"
    af = "(CASE WHEN (k.side > 0 AND z.h > k.ep) OR (k.side < 0 AND z.l < k.ep) THEN least(k.af + 0.02, 0.2) ELSE k.af END)"
    turn = f"((k.side > 0 AND z.l <= {stop}) OR (k.side < 0 AND z.h >= {stop}))"
    sar.recursive(
        "side, stop, ep, af",
        "SELECT symbol, t, (CASE WHEN h - h1 >= l1 - l THEN 1.0 ELSE -1.0 END)::DOUBLE, CASE WHEN h - h1 >= l1 - l THEN l1 ELSE h1 END, CASE WHEN h - h1 >= l1 - l THEN h ELSE l END, 0.02::DOUBLE FROM {} WHERE t = 2",
        f"CASE WHEN {turn} THEN -k.side ELSE k.side END, CASE WHEN {turn} THEN {ep} ELSE {stop} END, CASE WHEN {turn} THEN (CASE WHEN k.side > 0 THEN z.l ELSE z.h END) ELSE {ep} END, CASE WHEN {turn} THEN 0.02 ELSE {af} END",
    )
    out["parabolic_sar"] = sar.rows(value="stop")
    return out


def _pnl() -> dict[str, str]:
    turn = lambda x: f"abs({x} - lag({x}, 1, 0.0::DOUBLE) {ROWS})"
    return _values(
        cost_borrow="greatest(-q, 0) * c * 0.0001", cost_fixed=f"CASE WHEN {turn('q')} > 0 THEN 1.0 ELSE 0.0 END", cost_funding="q * c * f",
        cost_notional=f"{turn('q')} * c * 0.001", cost_per_share=f"{turn('q')} * 0.01", cost_proportional=f"{turn('w')} * 0.001", cost_slippage=f"{turn('w')} * 0.002",
        cumulative_pnl=f"CASE WHEN r IS NOT NULL THEN sum(r) {RUN} END", dividend="q * d", equity_curve="e", pnl_gross=f"q * (c - {lag('c')})",
        pnl_gross_inverse=f"q * 1000 * (1 / {lag('c')} - 1 / c)", pnl_net="q - k", returns_gross="w * r", returns_log=f"ln(c / {lag('c')})", returns_net="r - k",
        returns_simple=f"c / {lag('c')} - 1", turnover=turn("w"),
    )


def _metrics() -> dict[str, str]:
    q, rt = Query, "sqrt(252.0)"
    free = repr(1.02 ** (1 / 252) - 1)
    m2, m3, m4 = "avg(x2)", "avg(x3)", "avg(x4)"
    moments = lambda: q().let(gm="avg(r) OVER (PARTITION BY symbol)").let(x2="pow(r - gm, 2)", x3="pow(r - gm, 3)", x4="pow(r - gm, 4)")
    skew, kurt = f"({m3} / pow({m2}, 1.5))", f"({m4} / ({m2} * {m2}) - 3)"
    plain = lambda **x: {k: q().groups(v) for k, v in x.items()}
    wins = "(count(*) FILTER (r > 0))::DOUBLE / (count(*) FILTER (r <> 0))"
    payoff = "(avg(r) FILTER (r > 0)) / -(avg(r) FILTER (r < 0))"
    gain, loss = "avg(CASE WHEN r > 0 THEN r WHEN r IS NOT NULL THEN 0 END)", "avg(CASE WHEN r < 0 THEN -r WHEN r IS NOT NULL THEN 0 END)"
    tail = "abs(quantile_cont(r, 0.95) / quantile_cont(r, 0.05))"
    down = "sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END))"
    slope = "(covar_pop(r, b) / var_pop(b) FILTER (r IS NOT NULL))"
    legs = lambda x, s: f"(pow(product(1 + {x}) FILTER (r IS NOT NULL AND b {s} 0), 252.0 / count(*) FILTER (r IS NOT NULL AND b {s} 0)) - 1)"
    up, dn = f"{legs('r', '>')} / {legs('b', '>')}", f"{legs('r', '<')} / {legs('b', '<')}"
    out = plain(
        alpha=f"pow(1 + avg(r) - {slope} * (avg(b) FILTER (r IS NOT NULL)), 252) - 1", beta=slope, capture_upside_ratio=up, capture_downside_ratio=dn, capture_ratio=f"({up}) / ({dn})",
        common_sense_ratio=f"{gain} / {loss} * {tail}", downside_deviation=f"{down} * {rt}", gain_to_pain_ratio=f"avg(r) / {loss}",
        information_ratio=f"avg(r - b) / stddev_samp(r - b) * {rt}", kelly_criterion=f"{wins} - (1 - {wins}) / ({payoff})",
        modigliani_risk_adjusted_performance=f"0.02 + avg(r - {free}) * 252 / (stddev_samp(r) * {rt}) * stddev_samp(b) FILTER (r IS NOT NULL) * {rt}",
        omega_ratio=f"{gain} / {loss}", payoff_ratio=payoff, profit_factor=f"{gain} / {loss}", risk_of_ruin=f"least(1.0, pow((1 - {wins}) / ({wins}), count(r)))",
        sharpe_ratio=f"avg(r - {free}) * 252 / (stddev_samp(r) * {rt})", sortino_ratio=f"avg(r) * 252 / ({down} * {rt})", tail_ratio=tail,
        treynor_ratio=f"avg(r) * 252 / {slope}", value_at_risk="quantile_cont(r, 0.05)", value_at_risk_parametric="avg(r) + -1.6448536269514722 * stddev_samp(r)",
        volatility=f"stddev_samp(r) * {rt}", win_rate=wins,
    )
    out["skewness"], out["kurtosis"] = moments().groups(skew), moments().groups(kurt)
    s = "(avg(r) / stddev_samp(r))"
    out["adjusted_sharpe_ratio"] = moments().groups(f"{rt} * {s} * (1 + {skew} / 6 * {s} - {kurt} / 24 * {s} * {s})")
    z = -1.6448536269514722
    cf = f"({z} + {(z * z - 1) / 6!r} * {skew} + {(z**3 - 3 * z) / 24!r} * {kurt} - {(2 * z**3 - 5 * z) / 36!r} * {skew} * {skew})"
    sl = f"(1 + {z / 3!r} * {skew} + {(z * z - 1) / 8!r} * {kurt} - {(6 * z * z - 5) / 36!r} * {skew} * {skew})"
    out["value_at_risk_modified"] = moments().groups(f"CASE WHEN {sl} <= 0 OR {cf} * {z} < 0 THEN {NAN} ELSE avg(r) + {cf} * stddev_samp(r) END")
    # The normal distribution by Simpson's rule on [0, x]; far finer than the digits compared.
    arg = f"({s} * sqrt(count(r) - 1) / sqrt(1 - {skew} * {s} + ({kurt} + 2) / 4 * {s} * {s}))"
    psr = moments()
    inner = f"SELECT symbol, {arg} AS x FROM {psr.at} GROUP BY symbol"
    simpson = "0.5 + x / 2000 / 3 / sqrt(2 * pi()) * (SELECT sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 2000, 2) / 2)) FROM range(2001) g(i))"
    out["probabilistic_sharpe_ratio"] = f"WITH RECURSIVE {', '.join(psr.parts)}, y AS ({inner}) SELECT symbol, round({simpson} + {NUDGE}, {DIGITS}) AS value FROM y"
    dd = lambda: q().let(dd=f"e / max(e) {RUN} - 1")
    last, mdd, pain, ulcer = "arg_max(e, t) FILTER (e IS NOT NULL)", "abs(min(dd))", "avg(abs(dd))", "sqrt(avg(dd * dd))"
    cagr = f"(pow({last}, 252.0 / count(e)) - 1)"
    ratios = {
        "burke_ratio": f"{cagr} / sqrt(sum(dd * dd))", "cagr": cagr, "calmar_ratio": f"{cagr} / {mdd}", "max_drawdown": "min(dd)", "pain_index": pain, "pain_ratio": f"{cagr} / {pain}",
        "recovery_ratio": f"({last} - 1) / {mdd}", "sterling_ratio": f"{cagr} / ({pain} + 0.1)", "total_return": f"{last} - 1", "ulcer_index": ulcer, "ulcer_performance_ratio": f"{cagr} / {ulcer}",
    }
    out |= {k: dd().groups(x) for k, x in ratios.items()}
    for name, x, base in (("conditional_value_at_risk", "r", q()), ("conditional_drawdown_at_risk", "dd", dd())):
        ranked = base.let(i=f"row_number() OVER (PARTITION BY symbol ORDER BY {x} NULLS LAST) - 1", n=f"count({x}) OVER (PARTITION BY symbol)")
        ranked.let(wt=f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, {1 - 0.95!r} * n - i)) END")
        out[name] = ranked.groups(f"sum(wt * {x}) / sum(wt)")
    out["max_drawdown_duration"] = dd().let(isle=f"sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) {RUN}").let(n=f"sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, isle)").groups("max(n)::DOUBLE")
    out["stability"] = q().let(path=f"CASE WHEN r IS NOT NULL THEN sum(ln(1 + r)) {RUN} END", i=f"CASE WHEN r IS NOT NULL THEN count(r) {RUN} END").groups("pow(corr(i, path), 2)")
    # Rolling.
    n = 20
    sd = roll("stddev_samp({})", "r", n)
    short = "CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END"
    sloper = f"(CASE WHEN count(r + b) {over(n)} = {n} THEN regr_slope(r, b) {over(n)} END)"
    out |= _values(
        alpha_rolling=f"pow(1 + {mean('r', n)} - {sloper} * {mean('b', n)}, 252) - 1", beta_rolling=sloper, treynor_ratio_rolling=f"{mean('r', n)} * 252 / {sloper}",
        cagr_rolling=f"pow(e / {lag('e', 19)}, 252.0 / 19) - 1", total_return_rolling=f"e / {lag('e', 19)} - 1", drawdown=f"e / max(e) {RUN} - 1",
        drawdown_rolling=f"e / {top('e', n)} - 1", volatility_rolling=f"{sd} * {rt}", sharpe_ratio_rolling=f"{mean('r', n)} * 252 / ({sd} * {rt})",
        information_ratio_rolling=f"{mean('r - b', n)} * 252 / ({roll('stddev_samp({})', 'r - b', n)} * {rt})",
        value_at_risk_rolling=roll("quantile_cont({}, 0.05)", "r", n), tail_ratio_rolling=f"abs({roll('quantile_cont({}, 0.95)', 'r', n)} / {roll('quantile_cont({}, 0.05)', 'r', n)})",
    )
    out["downside_deviation_rolling"] = q().let(x=short).rows(value=f"sqrt({mean('x', n)}) * {rt}")
    out["sortino_ratio_rolling"] = q().let(x=short).rows(value=f"{mean('r', n)} * 252 / (sqrt({mean('x', n)}) * {rt})")
    out["omega_ratio_rolling"] = q().let(g="CASE WHEN r > 0 THEN r WHEN r IS NOT NULL THEN 0 END", s="CASE WHEN r < 0 THEN -r WHEN r IS NOT NULL THEN 0 END").rows(value=f"{mean('g', n)} / {mean('s', n)}")
    centred = lambda: q().let(xs=f"CASE WHEN count(r) {over(n)} = {n} THEN list(r) {over(n)} END").let(m="list_avg(xs)").let(c2="list_avg(list_transform(xs, lambda x: pow(x - m, 2)))", c3="list_avg(list_transform(xs, lambda x: pow(x - m, 3)))", c4="list_avg(list_transform(xs, lambda x: pow(x - m, 4)))")
    out["skewness_rolling"], out["kurtosis_rolling"] = centred().rows(value="c3 / pow(c2, 1.5)"), centred().rows(value="c4 / (c2 * c2) - 3")
    return out


STRATEGY = f"""WITH {BASE.partition('num AS')[0].rstrip().rstrip(',')},
a AS (SELECT symbol, bar, c, c / lag(c) OVER w - 1 AS asset,
  CASE WHEN (CASE WHEN count(c) OVER w5 = 5 THEN avg(c) OVER w5 END) > (CASE WHEN count(c) OVER w10 = 10 THEN avg(c) OVER w10 END) THEN 1.0::DOUBLE
       WHEN count(c) OVER w10 = 10 THEN 0.0::DOUBLE END AS sig
  FROM ohlc WINDOW w AS (PARTITION BY symbol ORDER BY bar), w5 AS (PARTITION BY symbol ORDER BY bar ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY bar ROWS 9 PRECEDING)),
b AS (SELECT *, lag(sig) OVER (PARTITION BY symbol ORDER BY bar) AS wt FROM a),
n AS (SELECT *, wt * asset - abs(wt - lag(wt, 1, 0.0::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar)) * 0.001 AS net FROM b),
e AS (SELECT *, CASE WHEN net IS NOT NULL THEN product(1 + net) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) END AS eq FROM n),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)
SELECT symbol, count(*) AS bars, round(avg(net) * 252 / (stddev_samp(net) * sqrt(252.0)) + {NUDGE}, {DIGITS}) AS sharpe_ratio,
  round(arg_max(eq, bar) FILTER (eq IS NOT NULL) - 1 + {NUDGE}, {DIGITS}) AS total_return, round(min(dd) + {NUDGE}, {DIGITS}) AS max_drawdown FROM d GROUP BY symbol"""


def oracle_sql() -> dict[str, str]:
    found = {"indicators": _indicators(), "pnl": _pnl(), "metrics": _metrics()}
    out = {"strategy_report": STRATEGY}
    for family, (_, specs) in FAMILIES.items():
        out |= {f"{family}_{name}": sql for name, sql in found[family].items() if name in specs}
    return out
