"""Tail probabilities in DuckDB SQL, by finite series: they check those that the operators compute by continued fraction."""

from __future__ import annotations

#: +1 where a higher value is better, -1 where a lower one is.
SIGN = "case when metric = 'dice' then 1 else -1 end"

#: Counts of the signed-rank statistic of k pairs, for k up to 50: we(k, c), c[w + 1] of 2^k.
EXACT = ", we(k, c) as (select 0, [1::bigint] union all select k + 1, list_transform(range(0, len(c) + k + 1), lambda i: coalesce(c[i + 1], 0) + case when i > k then coalesce(c[i - k], 0) else 0 end) from we where k < 50)"


def t_sf(t: str, v: str) -> str:
    """P(T > t) for v whole degrees of freedom."""
    cos2, sin = f"({v} / ({v} + {t} * {t}))", f"(abs({t}) / sqrt({v} + {t} * {t}))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({v})) + {sin} * sqrt(pi()) / 2 * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({cos2}, j + 0.5))), 0))"
    even = f"{sin} / sqrt(pi()) * list_sum(list_transform(range(0, {v} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) * pow({cos2}, j)))"
    return f"(0.5 - sign({t}) / 2 * (case when {v} % 2 = 1 then {odd} else {even} end))"


def normal_sf(z: str) -> str:
    """P(Z > z), for |z| below 20."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2 - {z} * {z} / 2)"
    return f"(case when {z} = 0 then 0.5 else 0.5 - sign({z}) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda k: {term})) end)"


def t_columns(by: str, source: str = "pt", least: int = 2) -> str:
    """CTE tt: n, mean, sd, t, p, p_better of the differences by group."""
    return f", t0 as (select {by}, count(*) as n, avg(diff) as mean, stddev_samp(diff) as sd, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) as t from {source} group by {by} having count(*) >= {least}), tt as (select *, 2 * {t_sf('abs(t)', '(n - 1)')} as p, {t_sf(f'(t * {SIGN})', '(n - 1)')} as p_better from t0)"


T_OUT = "n, round(mean, 6) as mean, round(sd, 6) as sd, round(t, 6) as t, round(p, 6) as p, round(p_better, 6) as p_better"


def rank_columns(by: str, source: str = "pt", value: str = "diff", sign: str = SIGN) -> str:
    """CTE wx: n, w_plus, z, tied, p, p_better of the signed-rank test by group."""
    joined = ", ".join("zr." + k.strip() for k in by.split(","))
    return EXACT + f""", z0 as (select {by}, {value} as v, round(abs({value}), 9) as size from {source}),
zr as (select *, rank() over (partition by {by}, size > 0 order by size) + (count(*) over (partition by {by}, size) - 1) / 2 as rk, count(*) over (partition by {by}, size) as ties from z0),
zs as (select {joined}, count(*) filter (size > 0) as n, count(*) filter (size = 0) as zeros, coalesce(sum(rk) filter (size > 0 and v > 0), 0) as w_plus, coalesce(sum(ties * ties - 1) filter (size > 0), 0) as tie_term from zr group by {joined} having count(*) filter (size > 0) > 0),
zz as (select *, (w_plus - n * (n + 1) / 4) / sqrt(nullif(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48, 0)) as z, tie_term > 0 as tied, {sign} as sg from zs),
ze as (select zz.*, n <= 50 and tie_term = 0 and zeros = 0 as exact, list_sum(list_slice(c, w_plus::int + 1, len(c))) / pow(2, n) as up, list_sum(list_slice(c, (n * (n + 1) / 2 - w_plus)::int + 1, len(c))) / pow(2, n) as down from zz left join we on we.k = zz.n),
wx as (select *, case when z is null then null when exact then least(1, 2 * least(up, down)) else 2 * {normal_sf('abs(z)')} end as p, case when z is null then null when exact then case when sg > 0 then up else down end else {normal_sf('(z * sg)')} end as p_better from ze)"""


W_OUT = "n, round(w_plus, 6) as w_plus, round(z, 6) as z, tied, round(p, 6) as p, round(p_better, 6) as p_better"


def bootstrap(by: str, source: str, draws: int, seed: int = 0) -> str:
    """CTE bt: low, high by group, with the weights of the operator."""
    p = 2147483647
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    weight = " + ".join(f"(u >= {c}::double)::int" for c in cuts)
    return f""", b0 as (select {by}, diff, ('0x' || substr(md5('{seed}:' || case_name), 1, 7))::bigint as h from {source}),
b1 as (select b0.*, b, (h + b * 1000003) % {p} as x from b0, range(1, {draws + 1}) r(b)), b2 as (select *, (x * x + h) % {p} as y from b1), b3 as (select *, ((y * y + b) % {p})::double / {p} as u from b2),
b4 as (select {by}, b, sum(({weight}) * diff) / nullif(sum({weight}), 0) as m from b3 group by {by}, b), bt as (select {by}, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from b4 group by {by})"""
