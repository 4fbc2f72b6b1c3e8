"""SQL equivalents of the registered queries, run on the same tables by another engine.

Written from the definitions, not from the Spark plans: frames by RANGE windows, prices by bisection,
score grids by summing cells.
"""

from __future__ import annotations

import math
import re

ORACLES: dict[str, str] = {}


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({expr}) + 1e-9::double, {digits}) + 0.0 as {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def once(ctes: list[str]) -> list[str]:
    """CTEs computed once each, however often they are read; self-referring ones stay as they are."""
    out = []
    for cte in ctes:
        name, _, rest = cte.partition(" as (")
        own = re.search(rf"\b{re.escape(name.strip())}\b", rest)
        out.append(cte if own or "(" in name else f"{name} as materialized ({rest}")
    return out


def add(name: str, ctes: list[str], body: str) -> None:
    ORACLES[name] = ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _triple(mod: int, names: tuple[str, str, str]) -> str:
    q = "cast(l_quantity as int)"
    w = [f"(2 + {q} % {mod})", "3", "(1 + l_partkey % 5)"]
    tot = f"cast({' + '.join(w)} as double)"
    return ", ".join(f"round({d(1.0)} / ((cast({x} as double) / {tot}) * ({d(1.03)} + l_discount)), 2) as {n}" for x, n in zip(w, names))


_over, _under = "(2 + cast(l_quantity as int) % 5)", "(2 + l_linenumber % 4)"
_both = f"cast({_over} + {_under} as double)"
CONTESTS = [
    "k as (select count(*) // 5 as k from supplier)",
    f"""raw as (select l_suppkey % 5 as league, l_suppkey as home, l_suppkey % 5 + 5 * (l_partkey % (select k from k)) as away,
 cast(l_quantity as int) % 5 as gh, l_linenumber % 4 as ga, cast(l_shipdate as date) as d,
 {_triple(7, ("o1", "ox", "o2"))}, {_triple(6, ("z1", "zx", "z2"))},
 round({d(1.0)} / ((cast({_over} as double) / {_both}) * ({d(1.02)} + l_tax)), 2) as oover,
 round({d(1.0)} / ((cast({_under} as double) / {_both}) * ({d(1.02)} + l_tax)), 2) as ounder,
 case when l_linenumber <> 5 then cast(l_quantity as int) % 9 end as hst, case when l_linenumber <> 5 then cast(l_partkey % 8 as int) end as ast,
 cast(l_quantity as int) % 11 as hc, cast(l_orderkey % 7 as int) as ac,
 l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem)""",
    """contests as (select league, cast(year(d) - case when month(d) < 7 then 1 else 0 end as int) as season,
 row_number() over (partition by league order by d, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as match_seq,
 d, home, away, gh, ga, o1, ox, o2, case when l_linenumber <> 7 then z1 end as c1, case when l_linenumber <> 7 then zx end as cx,
 case when l_linenumber <> 7 then z2 end as c2, oover, ounder, hst, ast, hc, ac from raw where home <> away)""",
]
APP = ["""app as (select league, season, match_seq, d, home as team, away as opp, 'H' as venue, gh as gf, ga, pow(2, datediff('day', date '1998-01-01', d) / 730.0) as e from contests
 union all select league, season, match_seq, d, away, home, 'A', ga, gh, pow(2, datediff('day', date '1998-01-01', d) / 730.0) from contests)"""]


def state(frame: str | None) -> list[str]:
    """Team and league state; ``frame`` is the reach in league rows or None for all history."""
    rng = f"range between {frame} preceding and 1 preceding" if frame else "rows between unbounded preceding and 1 preceding"
    lim = f"x.s >= match_seq - {frame}" if frame else "true"
    item = "{'s': match_seq, 'gf': gf, 'ga': ga}"
    lists = ", ".join(f"list({item}) filter (where venue = '{v}') over ft as l{v}" for v in "HA")
    return CONTESTS + APP + [
        f"""st0 as (select *, sum(e) over fv as sw, sum(e * gf) over fv as sf, sum(e * ga) over fv as sg, count(*) over ft as n_prior, {lists} from app
 window fv as (partition by league, team, venue order by match_seq {rng}), ft as (partition by league, team order by match_seq {rng}))""",
        "st1 as (select *, coalesce(list_sort(lH)[-3:], []) as h3, coalesce(list_sort(lA)[-3:], []) as a3 from st0)",
        """st2 as (select league, match_seq, venue, n_prior, coalesce(sf / sw, 0.0) as gf_venue, coalesce(sg / sw, 0.0) as ga_venue,
 len(h3) + len(a3) as form_n, case when venue = 'H' then len(h3) else len(a3) end as form_venue_n,
 coalesce(list_sum(list_transform(list_concat(h3, a3), lambda x: x.gf)) / (len(h3) + len(a3)), 0.0) as form_gf,
 coalesce(list_sum(list_transform(list_concat(h3, a3), lambda x: x.ga)) / (len(h3) + len(a3)), 0.0) as form_ga,
 coalesce(list_sum(list_transform(case when venue = 'H' then h3 else a3 end, lambda x: x.gf)) / (case when venue = 'H' then len(h3) else len(a3) end), 0.0) as form_venue_gf from st1)""",
        f"""lg as (select *, pow(2, datediff('day', date '1998-01-01', d) / 730.0) as e,
 list({{'s': match_seq, 'home': home, 'gh': gh, 'ga': ga}}) over (partition by league, least(home, away), greatest(home, away) order by match_seq rows between 10 preceding and 1 preceding) as met0 from contests)""",
        f"""lg1 as (select *, {f'least(match_seq, {frame})' if frame else 'match_seq'} as n_league, sum(e * gh) over w / sum(e) over w as mean_home, sum(e * ga) over w / sum(e) over w as mean_away,
 avg(gh) over w as run_home, avg(ga) over w as run_away,
 list_filter(coalesce(met0, []), lambda x: {lim}) as met1 from lg window w as (partition by league order by match_seq {rng}))""",
        """lg2 as (select *, len(met1) as met, case when len(met1) > 0 then list_sum(list_transform(met1, lambda x: case when x.home = home then x.gh else x.ga end)) / len(met1) end as met_gf,
 case when len(met1) > 0 then list_sum(list_transform(met1, lambda x: case when x.home = home then x.ga else x.gh end)) / len(met1) end as met_ga from lg1)""",
        """sta as (select g.*, h.n_prior as h_n_prior, h.gf_venue as h_gf_venue, h.ga_venue as h_ga_venue, h.form_n as h_form_n, h.form_gf as h_form_gf, h.form_ga as h_form_ga, h.form_venue_n as h_form_venue_n, h.form_venue_gf as h_form_venue_gf,
 a.n_prior as a_n_prior, a.gf_venue as a_gf_venue, a.ga_venue as a_ga_venue, a.form_n as a_form_n, a.form_gf as a_form_gf, a.form_ga as a_form_ga, a.form_venue_n as a_form_venue_n, a.form_venue_gf as a_form_venue_gf
 from lg2 g join st2 h on h.league = g.league and h.match_seq = g.match_seq and h.venue = 'H' join st2 a on a.league = g.league and a.match_seq = g.match_seq and a.venue = 'A')""",
    ]


def shin(name: str, source: str, cols: list[str]) -> list[str]:
    """Table ``name`` with the distinct prices and their probabilities p0.. by bisection on z."""
    n = len(cols)
    s = " + ".join(f"1.0 / {c}" for c in cols)
    p = [f"((sqrt(z * z + 4 * (1 - z) * (1.0 / {c}) * (1.0 / {c}) / s) - z) / (2 * (1 - z)))" for c in cols]
    names = ", ".join(cols)
    return [
        f"{name}_d as (select distinct {names}, {s} as s from {source} where {' and '.join(c + ' is not null' for c in cols)})",
        f"""{name}_b as (select {names}, s, {d(0.0)} as lo, {d(1 - 1e-9)} as hi, 0 as n from {name}_d
 union all select {names}, s, case when f > 0 then z else lo end, case when f > 0 then hi else z end, n + 1
 from (select *, {' + '.join(p)} - 1 as f from (select *, (lo + hi) / 2 as z from {name}_b where n < 60)))""",
        f"{name}_z as (select {names}, s, {', '.join(f'{x} as p{i}' for i, x in enumerate(p))} from (select *, (lo + hi) / 2 as z from {name}_b where n = 60))",
        f"""{name} as (select {names}, {', '.join(f'case when s <= 1 then (1.0 / {c}) / s else p{i} / ({" + ".join(f"p{j}" for j in range(n))}) end as p{i}' for i, c in enumerate(cols))} from {name}_z)""",
    ]


MARKET = ["""mk0 as (select league, match_seq, case when c1 is not null and cx is not null and c2 is not null then c1 else o1 end as u1,
 case when c1 is not null and cx is not null and c2 is not null then cx else ox end as ux, case when c1 is not null and cx is not null and c2 is not null then c2 else o2 end as u2, oover, ounder from contests)""",
          *shin("sh3", "mk0", ["u1", "ux", "u2"]), *shin("sh2", "mk0", ["oover", "ounder"]),
          """mk as (select league, match_seq, s.p0 as q1, s.p1 as qx, s.p2 as q2, t.p0 as q_over from mk0 join sh3 s using (u1, ux, u2) join sh2 t using (oover, ounder))"""]


def xg(mean_home: str, mean_away: str, where: str, market: list[str] = MARKET) -> list[str]:
    gen = f"(({mean_home} + {mean_away}) / 2)"
    return [*market, f"""cp0 as (select sta.*, h_gf_venue * a_ga_venue / {mean_away} as xh_hist, a_gf_venue * h_ga_venue / {mean_home} as xa_hist, {mean_home} as mh, {mean_away} as ma, {gen} as mg from sta where {where})""",
            """comps as (select c.league, season, c.match_seq, d, home, away, gh, ga, xh_hist, xa_hist,
 case when h_form_venue_gf > 0 then h_form_venue_gf * greatest(a_form_ga, 0.3) / ma else xh_hist end as xh_form,
 case when a_form_venue_gf > 0 then a_form_venue_gf * greatest(h_form_ga, 0.3) / mh else xa_hist end as xa_form,
 case when met > 0 then met_gf / mg * mh else xh_hist end as xh_meet, case when met > 0 then met_ga / mg * ma else xa_hist end as xa_meet,
 met > 0 as meet_valid, case when gh > ga then '1' when gh = ga then 'X' else '2' end as actual, gh + ga > 2 as over_actual,
 q1, qx, q2, q_over from cp0 c join mk on mk.league = c.league and mk.match_seq = c.match_seq)"""]


READY = "n_league >= 100 and h_n_prior > 0 and a_n_prior > 0"
SEEN = "h_n_prior > 0 and a_n_prior > 0"
E1 = state("1600") + xg("mean_home", "mean_away", READY)


def cells(lam: str, mu: str, keep) -> str:
    """Sum of lam^i mu^j / (i! j!) over the chosen cells of the 11 x 11 grid."""
    return " + ".join(f"pow({lam}, {i}) * pow({mu}, {j}) * {d(1 / (math.factorial(i) * math.factorial(j)))}"
                      for i in range(11) for j in range(11) if keep(i, j))


def grid(name: str, source: str, keep: str, lam: str, mu: str, rho: str) -> list[str]:
    """Score model on the columns ``lam`` and ``mu``: adds b1, bx, b2, bo to the ``keep`` columns."""
    rb = f"least(greatest({rho}, greatest(-1 / {lam}, -1 / {mu})), least(1 / ({lam} * {mu}), 1.0))"
    return [
        f"""{name}_c as (select {keep}, {lam} * {mu} * {rb} as c, {cells(lam, mu, lambda i, j: i > j)} as gh_, {cells(lam, mu, lambda i, j: i == j)} as gx_,
 {cells(lam, mu, lambda i, j: i < j)} as ga_, {cells(lam, mu, lambda i, j: i + j > 2)} as go_ from {source})""",
        f"{name} as (select * exclude (c, gh_, gx_, ga_, go_), (gh_ + c) / (gh_ + gx_ + ga_) as b1, (gx_ - 2 * c) / (gh_ + gx_ + ga_) as bx, (ga_ + c) / (gh_ + gx_ + ga_) as b2, go_ / (gh_ + gx_ + ga_) as bo from {name}_c)",
    ]


def blend(name: str, source: str, form: str, meet: str, odds: str, rho: str = "-0.1", extra: str = "") -> list[str]:
    """Production blend of ``source`` rows: p1, px, p2."""
    keep = "league, season, match_seq, d, actual, over_actual, q1, qx, q2, q_over" + extra
    return [
        f"{name}_w as (select *, {form} as f0, case when meet_valid then {meet} else 0.0 end as m0, {odds} as w0 from {source})",
        f"{name}_v as (select *, case when f0 + m0 + w0 > 1 then f0 / (f0 + m0 + w0) else f0 end as wf, case when f0 + m0 + w0 > 1 then m0 / (f0 + m0 + w0) else m0 end as wm, case when f0 + m0 + w0 > 1 then w0 / (f0 + m0 + w0) else w0 end as wq from {name}_w)",
        f"{name}_u as (select *, case when f0 + m0 + w0 > 1 or abs(1 - wf - wm - wq) < 1e-12 then 0.0 else 1 - wf - wm - wq end as wh from {name}_v)",
        f"""{name}_x as (select {keep}, wq, greatest(0.05, case when wh + wf + wm > 0 then (wh * xh_hist + wf * xh_form + wm * xh_meet) / (wh + wf + wm) else xh_hist end) as xh,
 greatest(0.05, case when wh + wf + wm > 0 then (wh * xa_hist + wf * xa_form + wm * xa_meet) / (wh + wf + wm) else xa_hist end) as xa from {name}_u)""",
        *grid(f"{name}_g", f"{name}_x", keep + ", wq, xh, xa", "xh", "xa", rho),
        f"{name} as (select {keep}, xh, xa, (1 - wq) * b1 + wq * q1 as p1, (1 - wq) * bx + wq * qx as px, (1 - wq) * b2 + wq * q2 as p2 from {name}_g)",
    ]


def scored(name: str, source: str, rule: str = "strict") -> list[str]:
    pred = ("case when p1 > px and p1 > p2 then '1' when px > p2 then 'X' else '2' end" if rule == "strict"
            else "case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end")
    return [f"""{name} as (select *, pred = actual as hit, {RPS('p1', 'px')} as rps, -ln(least(greatest(case actual when '1' then p1 when 'X' then px else p2 end, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) as logloss
 from (select *, {pred} as pred from {source}))"""]


def RPS(a: str, b: str) -> str:
    return f"((pow({a} - (case when actual = '1' then 1.0 else 0.0 end), 2) + pow({a} + {b} - (case when actual = '2' then 0.0 else 1.0 end), 2)) / 2)"


METRICS = ("count(*) as n, cast(sum(case when hit then 1 else 0 end) as bigint) as hits, " + r("avg(case when hit then 1.0 else 0.0 end)", "accuracy") + ", "
           + r("avg(case when actual = '1' then 1.0 else 0.0 end)", "home_rate") + ", " + r("avg(case when pred = '1' then 1.0 else 0.0 end)", "pred_home_share")
           + ", " + r("avg(rps)", "rps") + ", " + r("avg(logloss)", "logloss"))
KEY = "league, season, match_seq"
DAY = "cast(d as varchar) as d"

# ------------------------------------------------------------------ matches and checks
add("contests", CONTESTS, f"select {KEY}, {DAY}, home, away, gh, ga, {rs('o1', 'ox', 'o2', 'c1', 'cx', 'c2', 'oover', 'ounder')}, hst, ast, hc, ac from contests")
add("market_by_league_season", CONTESTS + ["""pr as (select *, (1/o1)/(1/o1+1/ox+1/o2) as p1, (1/ox)/(1/o1+1/ox+1/o2) as px, (1/o2)/(1/o1+1/ox+1/o2) as p2, case when gh > ga then '1' when gh = ga then 'X' else '2' end as actual from contests)"""]
    + scored("sc", "pr", "first"), f"select coalesce(league, -1) as league, coalesce(season, -1) as season, {METRICS} from sc group by rollup (league, season)")
add("coverage_report", CONTESTS, "select league, season, count(*) as matches, count(d) as n_d, count(o1) as n_o1, count(c1) as n_c1, count(oover) as n_oover, count(hst) as n_hst from contests group by all")
add("integrity_checks", CONTESTS + ["dup as (select league, count(*) as duplicate_keys, max(n) as most_copies from (select league, d, home, away, gh, ga, count(*) as n from contests group by all having count(*) > 1) group by league)",
    "gap as (select league, max(season) - min(season) + 1 - count(distinct season) as missing_seasons from contests group by league)",
    "bk as (select league, cast(sum(case when p > d then 1 else 0 end) as bigint) as date_steps_back from (select league, d, lag(d) over (partition by league order by match_seq) as p from contests) group by league)"],
    "select league, coalesce(duplicate_keys, 0) as duplicate_keys, coalesce(most_copies, 0) as most_copies, missing_seasons, date_steps_back from gap left join dup using (league) join bk using (league)")
add("teams_and_seasons", CONTESTS, "select league, (select count(distinct t) from (select home as t, league as l from contests union select away, league from contests) where l = c.league) as teams, count(distinct season) as seasons from contests c group by league")
add("season_split", CONTESTS, f"""select case when season >= (select max(season) - 1 from contests) then 'test' else 'train' end as part, count(*) as n, min(season) as first_season, max(season) as last_season,
 {r('avg(gh)', 'mean_home')}, {r('avg(ga)', 'mean_away')}, {r('avg(gh) / avg(ga)', 'home_advantage')} from contests group by 1""")
_lines = """ln as (select *, season % 3 as s, match_seq % 97 = 5 and match_seq % 89 <> 3 and match_seq % 71 <> 13 as long97, match_seq % 71 = 13 and match_seq % 97 <> 5 and match_seq % 89 <> 3 as short71 from contests),
ok as (select *, case when match_seq % 83 = 7 then null else d end as dd from ln where match_seq % 97 <> 5 and match_seq % 89 <> 3 and match_seq % 79 <> 11)"""
_avg = "case when short71 then null when s = 0 and match_seq % 5 = 0 then null else o1 end"
add("season_files", CONTESTS + [_lines], f"""select 'L' || league as league, cast(season as varchar) as season, count(*) as matches, count(dd) as n_date, count({_avg}) as n_oddsavgh,
 count(case when s = 2 and not short71 then c1 end) as n_oddsavgch, count(case when s = 2 and not short71 then oover end) as n_oddsover25, count(case when s <> 1 and not short71 then o1 end) as n_b365h,
 {r('cast(sum(gh) as double)', 'home_goals')}, {r(f'sum({_avg})', 'sum_h')}, {r('sum(case when s = 2 and not short71 then c2 end)', 'sum_ca')}, cast(min(dd) as varchar) as first_date, cast(max(dd) as varchar) as last_date from ok group by 1, 2""")
add("season_files_by_row", CONTESTS + [_lines], f"""select season, count(*) as matches, count(case when not short71 then o1 end) as n_odds, {r('sum(case when not short71 then o1 end)', 'sum_h')}, {r('cast(sum(ga) as double)', 'away_goals')} from ok where dd is not null group by season""")

_codes = "['I1', 'E0', 'SP1', 'D1', 'F1'][cast(league as int) + 1]"
add("season_folder", CONTESTS + [_lines], f"""select {_codes} as league, cast(season as varchar) as season, count(*) as matches, count(dd) as n_date, count({_avg}) as n_oddsavgh,
 cast(sum(gh) as bigint) as home_goals, {r(f'sum({_avg})', 'sum_h')}, count(case when league = 1 and s = 2 then 1 end) as n_quote, count(case when not (league = 1 and s = 2) then 1 end) as n_accent,
 cast(min(dd) as varchar) as first_date from ok group by 1, 2""")
add("league_files", CONTESTS + [_lines], """select season, count(*) as matches, count(dd) as n_date, count(case when s <> 1 and not short71 then o1 end) as n_b365h, 0::bigint as n_psh,
 count(case when short71 then null when s = 0 and match_seq % 5 = 0 then null else o1 end) as n_oddsavgh, count(case when s = 2 and not short71 then c1 end) as n_oddsavgch, count(case when s = 2 and not short71 then oover end) as n_oddsover25, 0::bigint as n_oddscover25
 from ok where league = 1 and dd is not null group by season""")
add("rejected_season_lines", CONTESTS + ["""rj as (select case when match_seq % 97 = 5 then 'too many fields' when match_seq % 89 = 3 or match_seq % 79 = 11 then 'no goals' end as reason from contests)""",
    "nt as (select 'no team columns' as reason from contests where league = 0 and season = (select min(season) from contests))"],
    "select reason, count(*) as n from (select reason from rj where reason is not null union all select reason from nt) group by reason")
add("match_store", CONTESTS, f"select league, season, count(*) as matches, cast(sum(gh) as bigint) as home_goals, cast(sum(ga) as bigint) as away_goals, {r('sum(o1)', 'sum_o1')} from contests where season >= (select max(season) - 2 from contests) group by league, season")

# ------------------------------------------------------------------ odds
add("odds_cascade", CONTESTS, f"""select {KEY}, {rs('s1', 'sx', 's2', 'f1')}, source, {rs('oover', 'ounder')}, {r('1/s1 + 1/sx + 1/s2 - 1', 'margin')}, case when oover > 1 and ounder > 1 then 1 else 0 end as has_ou
 from (select *, coalesce(c1, o1) as f1, case when c1 is null then o1 else c1 end as s1, case when c1 is null then ox else cx end as sx, case when c1 is null then o2 else c2 end as s2, case when c1 is null then 'opening' else 'closing' end as source from contests)""")
add("shin_probabilities", CONTESTS + shin("so", "contests", ["o1", "ox", "o2"]) + shin("sc", "contests", ["c1", "cx", "c2"]) + shin("su", "contests", ["oover", "ounder"]),
    f"""select {KEY}, {r('a.p0', 'p1')}, {r('a.p1', 'px')}, {r('a.p2', 'p2')}, {r('b.p0', 'k1')}, {r('b.p1', 'kx')}, {r('b.p2', 'k2')}, {r('u.p0', 'p_over')}, {r('u.p1', 'p_under')}
 from contests join so a using (o1, ox, o2) left join sc b using (c1, cx, c2) join su u using (oover, ounder)""")
add("match_analysis", CONTESTS + shin("so", "contests", ["o1", "ox", "o2"]),
    f"""select {KEY}, 1 as valid, {r('p0', 'prob_1')}, {r('p1', 'prob_x')}, {r('p2', 'prob_2')}, pick, {r("case pick when '1' then p0 when 'X' then p1 else p2 end", 'confidence')}, {r("case pick when '1' then o1 when 'X' then ox else o2 end", 'pick_odds')}, {r('1/o1 + 1/ox + 1/o2 - 1', 'margin')}
 from (select *, case when round(p0, 12) >= round(p1, 12) and round(p0, 12) >= round(p2, 12) then '1' when round(p1, 12) >= round(p2, 12) then 'X' else '2' end as pick from contests join so using (o1, ox, o2))""")

# ------------------------------------------------------------------ decay and state
_h = {"730": "pow(0.5, datediff('day', d, (select max(d) - 127 from contests)) / 730.0)"}
_decay = lambda h: f"(case when d > (select max(d) - 127 from contests) then 1.0 else pow(0.5, datediff('day', d, (select max(d) - 127 from contests)) / {h}) end)"
add("decayed_means", CONTESTS, " union all ".join(
    f"select league, home, {r(e, 'mean')}, '{n}' as half_life from contests group by league, home"
    for n, e in (("730", f"sum(gh * {_decay('730.0')}) / sum({_decay('730.0')})"), ("90", f"sum(gh * {_decay('90.0')}) / sum({_decay('90.0')})"), ("none", "avg(gh)"))))
_w = "pow(0.5, greatest(datediff('day', d, (select max(d) from contests)), 0) / 730.0)"
add("league_means_fixed", CONTESTS, f"select league, {r(f'sum(gh * {_w}) / sum({_w})', 'mean_home')}, {r(f'sum(ga * {_w}) / sum({_w})', 'mean_away')}, {r('avg(gh)', 'plain_home')}, {r('avg(ga)', 'plain_away')}, {r('avg(gh) / avg(ga)', 'home_advantage')} from contests group by league")
add("team_strengths", CONTESTS + APP, "select league, team, " + ", ".join(
    r(f"coalesce(sum({g} * {_w}) filter (where venue = '{v}') / sum({_w}) filter (where venue = '{v}'), 0)", n)
    for g, v, n in (("gf", "H", "att_home"), ("ga", "H", "def_home"), ("gf", "A", "att_away"), ("ga", "A", "def_away"))) + " from app group by league, team")
_state_cols = ("cast(met as int) as met, " + rs("met_gf", "met_ga", "mean_home", "mean_away") + ", n_league, " + ", ".join(
    f"{p}_n_prior, cast({p}_form_n as int) as {p}_form_n, cast({p}_form_venue_n as int) as {p}_form_venue_n, " + rs(f"{p}_gf_venue", f"{p}_ga_venue", f"{p}_form_gf", f"{p}_form_ga", f"{p}_form_venue_gf") for p in "ha"))
add("walk_forward_state", state("1600"), f"select {KEY}, {DAY}, home, away, {_state_cols} from sta")
add("unbounded_state", state(None), f"select {KEY}, {DAY}, home, away, {_state_cols}, {rs('run_home', 'run_away')} from sta")

# ------------------------------------------------------------------ optional features
add("form_rest_venue", CONTESTS + APP, f"""select league, season, match_seq, {DAY}, team, venue, {r('avg(gf) over w', 'form_gf')}, {r('avg(ga) over w', 'form_ga')},
 coalesce(string_agg(case when gf > ga then 'V' when gf = ga then 'N' else 'P' end, '') over w, '') as letters,
 cast(datediff('day', lag(d) over o, d) as double) as rest_days, case lag(venue) over o when 'A' then 1.0 when 'H' then 0.0 end as last_was_away from app
 window w as (partition by league, team order by match_seq rows between 3 preceding and 1 preceding), o as (partition by league, team order by match_seq)""")
add("congestion", CONTESTS + APP, f"select league, season, match_seq, team, venue, count(*) over (partition by league, team order by d range between interval 13 days preceding and interval 1 day preceding) as congestion from app")
_STATS = ["""sa as (select league, season, match_seq, d, home as team, 'H' as venue, hst as sf, ast as sa, hc as cf, ac as ca from contests union all select league, season, match_seq, d, away, 'A', ast, hst, ac, hc from contests)""",
    """sl as (select *, list({'s': match_seq, 'sf': sf, 'sa': sa, 'cf': cf, 'ca': ca}) filter (where venue = 'H') over w as lh, list({'s': match_seq, 'sf': sf, 'sa': sa, 'cf': cf, 'ca': ca}) filter (where venue = 'A') over w as la from sa
 window w as (partition by league, team order by match_seq rows between unbounded preceding and 1 preceding))""",
    "sp as (select *, list_concat(coalesce(list_sort(lh)[-5:], []), coalesce(list_sort(la)[-5:], [])) as l from sl)"]
add("recent_statistics", CONTESTS + _STATS,
    f"select league, season, match_seq, {DAY}, team, venue, " + ", ".join(r(f"list_avg(list_transform(l, lambda x: x.{c}))", n) for c, n in (("sf", "shots_for"), ("sa", "shots_against"), ("cf", "corners_for"), ("ca", "corners_against"))) + " from sp")
_pts = "case when gf > ga then 3 when gf = ga then 1 else 0 end"
_stand = ["std as (select *, coalesce(sum(" + _pts + ") over w, 0) as points, count(*) over w as played from app window w as (partition by league, season, team order by match_seq rows between unbounded preceding and 1 preceding))"]
add("progressive_standings", CONTESTS + APP + _stand, f"select {KEY}, team, venue, cast(points as bigint) as points, played from std")
# the whole table of the season before every match: each team's latest total carried forward
_PLACES = _stand + [
    "tm as (select league, season, team, count(*) over (partition by league, season) as teams from (select distinct league, season, team from app))",
    f"aft as (select league, season, team, match_seq, points + {_pts} as after from std)",
    """full_t as (select c.league, c.season, c.match_seq, t.team, t.teams, coalesce(a.after, 0) as pts from contests c join tm t on t.league = c.league and t.season = c.season
 asof left join aft a on a.league = t.league and a.season = t.season and a.team = t.team and a.match_seq < c.match_seq)""",
    "thr as (select league, season, match_seq, max(teams) as teams, list_reverse_sort(list(pts)) as l from full_t group by all)"]
add("table_thresholds", CONTESTS + APP + _PLACES,
    f"""select s.league, s.season, s.match_seq, s.team, s.venue, cast(s.points as bigint) as points, s.played, case when teams >= 17 then cast(s.points - l[17] as bigint) end as ahead_of_17, case when teams >= 17 then cast(s.points - l[6] as bigint) end as ahead_of_6
 from std s join thr t on t.league = s.league and t.season = s.season and t.match_seq = s.match_seq""")

# ------------------------------------------------------------------ lookups
RATE = ["""rt as (select team, 1500.0 + 100.0 * avg(gf - ga) as elo, cast(date_trunc('quarter', d) + interval 3 month as date) as f0, team % 7 = 0 as early from app group by team, date_trunc('quarter', d), team % 7)""",
        "rat as (select team, elo, f0, case when early then cast(f0 + interval 45 day as date) else cast(f0 + interval 3 month - interval 1 day as date) end as t0 from rt)"]
RATED = RATE + ["""rated as (select c.*, case when h.t0 >= c.d then h.elo end as elo_home, case when a.t0 >= c.d then a.elo end as elo_away from contests c
 asof left join rat h on h.team = c.home and h.f0 <= c.d asof left join rat a on a.team = c.away and a.f0 <= c.d)"""]
add("rating_file", CONTESTS + APP + RATE, f"""select cast(team as varchar) as team, count(*) as n, {r('avg(elo)', 'elo')}, cast(min(f0) as varchar) as first_day, cast(max(t0) as varchar) as last_day from rat group by team""")
add("external_goal_file", CONTESTS + APP + ["ext as (select league, team, d, venue, 0.3 + 0.8 * avg(gf) as xg from app where not (team % 11 = 3 and venue = 'A') group by all)"],
    f"""select case when team = 0 then 'FC Zero' else 'T' || team end as club, count(*) as n, cast(sum(case when venue = 'H' then 1 else 0 end) as bigint) as at_home, {r('sum(xg)', 'xg')} from ext where league = 0 group by 1""")
add("asof_ratings", CONTESTS + APP + RATED, f"select {KEY}, {DAY}, home, away, {rs('elo_home', 'elo_away')} from rated")
add("asof_events", ["rt as (select user_id, ts as since, max(value) as value from events where event_type = 'purchase' group by all)"],
    f"select e.event_id, e.user_id, {r('case when rt.since + interval 3 day >= e.ts then rt.value end', 'value')} from (select * from events where event_type = 'click') e asof left join rt on rt.user_id = e.user_id and rt.since <= e.ts")
add("missing_ratings", CONTESTS, f"select league, count(*) as n, 0 as rated, {r('exp(0.1)', 'xh_elo')}, {r('exp(0.0)', 'xa_elo')} from contests group by league")
add("external_goal_lookup", CONTESTS + APP + ["ext as (select team, d, venue, 0.3 + 0.8 * avg(gf) as xg from app where not (team % 11 = 3 and venue = 'A') group by team, d, venue)"],
    f"select c.league, c.season, c.match_seq, cast(c.d as varchar) as d, 'T' || c.home as home, 'T' || c.away as away, {r('h.xg', 'xg_home')}, {r('a.xg', 'xg_away')} from contests c join ext h on h.team = c.home and h.d = c.d and h.venue = 'H' join ext a on a.team = c.away and a.d = c.d and a.venue = 'A'")


def newton(name: str, goals: str) -> list[str]:
    """Two-parameter Poisson regression with a penalty on the slope, by Newton steps over the rated matches."""
    return [f"{name} as (select ln((select avg({goals}) from rd)) as b0, {d(0.0)} as b1, 0 as n union all select b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b1 + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01), n + 1 from (select b0, b1, n, sum({goals} - m) as g0, sum(({goals} - m) * x) - 1e-4 * count(*) * b1 as g1, sum(m) as h00, sum(m * x) as h01, sum(m * x * x) + 1e-4 * count(*) as h11 from (select b0, b1, n, x, gh, ga, exp(b0 + b1 * x) as m from {name}, rd where n < 12) group by b0, b1, n))"]


add("rating_regression", CONTESTS + APP + RATED + ["rd as (select elo_home - elo_away as x, gh, ga from rated where elo_home is not null and elo_away is not null)"] + newton("fh", "gh") + newton("fa", "ga"),
    f"""select league, count(*) as n, cast(sum(case when elo_home - elo_away is null then 0 else 1 end) as bigint) as rated, {r('avg(exp(fh.b0 + fh.b1 * coalesce(elo_home - elo_away, 0)))', 'xh_elo', 4)}, {r('avg(exp(fa.b0 + fa.b1 * coalesce(elo_home - elo_away, 0)))', 'xa_elo', 4)}, {r('max(exp(fh.b0 + fh.b1 * coalesce(elo_home - elo_away, 0)))', 'max_xh_elo', 4)}
 from rated, (select * from fh where n = 12) fh, (select * from fa where n = 12) fa group by league""")

# ------------------------------------------------------------------ components, scores, blends
XG = rs("xh_hist", "xa_hist", "xh_form", "xa_form", "xh_meet", "xa_meet")
_comp = f"{KEY}, {DAY}, home, away, gh, ga, {XG}, case when meet_valid then 1 else 0 end as meet_valid, actual, case when over_actual then 1 else 0 end as over_actual, {rs('q1', 'qx', 'q2')}, 1 as has_odds, {r('q_over')}, 1 as has_ou"
add("match_components", E1, f"select {_comp} from comps")
PLAIN = ["""pl as (select league, season, sum(h) over w / sum(n) over w as plain_home, sum(a) over w / sum(n) over w as plain_away from (select league, season, count(*) as n, sum(gh) as h, sum(ga) as a from contests group by all)
 window w as (partition by league order by season rows between unbounded preceding and 1 preceding))"""]
_mk_open = ["mk0 as (select league, match_seq, o1, ox, o2, oover, ounder from contests)", *shin("sh2", "mk0", ["oover", "ounder"]),
            "mk as (select league, match_seq, (1/o1)/(1/o1+1/ox+1/o2) as q1, (1/ox)/(1/o1+1/ox+1/o2) as qx, (1/o2)/(1/o1+1/ox+1/o2) as q2, t.p0 as q_over from mk0 join sh2 t using (oover, ounder))"]
_full_plain = lambda market: state(None) + PLAIN + ["sta_p as (select sta.*, plain_home, plain_away from sta join pl using (league, season))"] + [
    c.replace("sta.*", "sta_p.*").replace("from sta ", "from sta_p ") for c in xg("plain_home", "plain_away", SEEN, market)]
add("match_components_full", _full_plain(_mk_open), f"select {_comp} from comps")
add("score_outcomes", E1 + ["""cl as (select league, season, match_seq, xh_hist as l, xa_hist as m, case when xh_hist > 0 and xa_hist > 0 then least(greatest(-0.3, greatest(-1 / xh_hist, -1 / xa_hist)), least(1 / (xh_hist * xa_hist), 1.0)) else -0.3 end as rho from comps)""",
    """ce as (select league, season, match_seq, i, j, exp(-l) * pow(l, i) / factorial(cast(i as int)) * exp(-m) * pow(m, j) / factorial(cast(j as int)) *
 case when i = 0 and j = 0 then 1 - l * m * rho when i = 0 and j = 1 then 1 + l * rho when i = 1 and j = 0 then 1 + m * rho when i = 1 and j = 1 then 1 - rho else 1 end as p from cl, (select unnest(range(11)) as i) a, (select unnest(range(11)) as j) b)"""],
    "select league, season, match_seq, " + ", ".join(r(f"coalesce(sum(p) filter (where {c}), 0) / sum(p)", n) for c, n in (("i > j", "p1"), ("i = j", "px"), ("i < j", "p2"), ("i + j > 1", "over15"), ("i + j > 2", "over25"), ("i + j <= 2", "under25"))) + " from ce group by all")
add("blended_probabilities", E1 + blend("ba", "comps", "0.10", "0.0", "0.90") + blend("bb", "comps", "0.50", "0.40", "0.60", "-0.2"),
    f"select a.league, a.season, a.match_seq, {r('a.p1', 'p1')}, {r('a.px', 'px')}, {r('a.p2', 'p2')}, {r('a.xh', 'xh')}, {r('a.xa', 'xa')}, {r('b.p1', 'b1')}, {r('b.px', 'bx')}, {r('b.p2', 'b2')} from ba a join bb b on b.league = a.league and b.match_seq = a.match_seq")
OVER = lambda name, form, meet, extra="": [
    f"""{name}_x as (select * , greatest(0.05, (greatest(0, 1 - {form} - ms) * xh_hist + {form} * xh_form + ms * xh_meet) / (greatest(0, 1 - {form} - ms) + {form} + ms)) as l, greatest(0.05, (greatest(0, 1 - {form} - ms) * xa_hist + {form} * xa_form + ms * xa_meet) / (greatest(0, 1 - {form} - ms) + {form} + ms)) as m from (select *, case when meet_valid then {meet} else 0.0 end as ms from comps))""",
    *grid(name, f"{name}_x", "league, season, match_seq, over_actual, q_over" + extra, "l", "m", "-0.1")]
add("over_blend", E1 + OVER("oa", "0.1", "0.0") + OVER("ob", "0.15", "0.2"),
    f"select a.league, a.season, a.match_seq, {r('a.bo', 'p_model')}, {r('0.5 * b.bo + 0.5 * b.q_over', 'p_blend')}, {r('a.q_over', 'p_market')}, case when a.over_actual then 1 else 0 end as over_actual from oa a join ob b on b.league = a.league and b.match_seq = a.match_seq")
add("learner_features", E1, f"select {KEY}, actual, {rs('xh_hist', 'xa_hist', 'xh_form', 'xa_form')}, {r('case when meet_valid then xh_meet end', 'xh_meet')}, {r('case when meet_valid then xa_meet end', 'xa_meet')}, {rs('q1', 'qx', 'q2')} from comps")

# a window for each value of each team, put beside the match by venue
_GROUPS = E1 + RATED + _STATS + _PLACES + [
    "gr as (select league, match_seq, venue, datediff('day', lag(d) over o, d) as rest_days, case lag(venue) over o when 'A' then 1 when 'H' then 0 end as last_was_away from app window o as (partition by league, team order by match_seq))",
    "gc as (select league, match_seq, venue, count(*) over (partition by league, team order by d range between interval 13 days preceding and interval 1 day preceding) as congestion from app)",
    "gs as (select league, match_seq, venue, " + ", ".join(f"list_avg(list_transform(l, lambda x: x.{c})) as {n}" for c, n in (("sf", "shots_for"), ("sa", "shots_against"), ("cf", "corners_for"), ("ca", "corners_against"))) + " from sp)",
    "gp as (select s.league, s.match_seq, s.venue, s.played, case when teams >= 17 then s.points - l[17] end as ahead_of_17, case when teams >= 17 then s.points - l[6] end as ahead_of_6 from std s join thr t on t.league = s.league and t.season = s.season and t.match_seq = s.match_seq)",
    "ga_ as (select * from gr join gc using (league, match_seq, venue) join gs using (league, match_seq, venue) join gp using (league, match_seq, venue))"]
_group_names = ("shots_for", "shots_against", "corners_for", "corners_against", "rest_days", "congestion", "last_was_away", "ahead_of_17", "ahead_of_6", "played")
add("learner_feature_groups", _GROUPS, "select c.league, c.season, c.match_seq, " + ", ".join(r(f"c.{x}", x) for x in ("xh_hist", "xa_hist", "xh_form", "xa_form", "q1", "qx", "q2"))
    + f", {r('case when meet_valid then xh_meet end', 'xh_meet')}, {r('case when meet_valid then xa_meet end', 'xa_meet')}, {r('elo_home')}, {r('elo_away')}, {r('elo_home - elo_away', 'elo_diff')}, "
    + ", ".join(r(f"cast({p}.{n} as double)", f"{n}_{side}") for n in _group_names for p, side in (("h", "home"), ("a", "away")))
    + " from comps c join rated q on q.league = c.league and q.match_seq = c.match_seq join ga_ h on h.league = c.league and h.match_seq = c.match_seq and h.venue = 'H' join ga_ a on a.league = c.league and a.match_seq = c.match_seq and a.venue = 'A'")

# ------------------------------------------------------------------ backtest
PROD = E1 + blend("pd", "comps", "0.10", "0.0", "0.90")
add("backtest_metrics", once(PROD + scored("sc", "pd")), f"select coalesce(season, -1) as season, {METRICS} from sc group by rollup (season)")
add("backtest_by_league", once(PROD + scored("sc", "pd")), f"select league, season, {METRICS} from sc group by league, season")
add("confusion_matrix", PROD + scored("sc", "pd"), "select c as actual, " + ", ".join(f"(select count(*) from sc where actual = c and pred = '{k}') as pred_{k.lower()}" for k in "1X2") + " from (select unnest(['1', 'X', '2']) as c)")
add("class_report", PROD + scored("sc", "pd") + ["cr as (select c as label, (select count(*) from sc where actual = c) as support, (select count(*) from sc where pred = c) as said, (select count(*) from sc where pred = c and actual = c) as tp from (select unnest(['1', 'X', '2']) as c))"],
    f"select label, support, {r('coalesce(tp / nullif(said, 0), 0)', 'precision')}, {r('coalesce(tp / nullif(support, 0), 0)', 'recall')}, {r('coalesce(2.0 * tp / nullif(said + support, 0), 0)', 'f1')} from cr")
ORACLES["result_file"] = ORACLES["class_report"]
add("confidence_calibration", PROD + scored("sc", "pd", "first") + ["bn as (select league, floor((conf - 0.5) / 0.05 + 1e-9) as b, count(*) as n, avg(conf) as c, avg(case when hit then 1.0 else 0.0 end) as h from (select *, greatest(p1, px, p2) as conf from sc) where conf >= 0.5 and conf < 1 group by all having count(*) >= 50)"],
    f"select league, {r('sum(abs(c - h) * n) / sum(n)', 'calibration_gap')}, count(*) as bins from bn group by league")

# ------------------------------------------------------------------ experiments on all history
FULL = state(None) + xg("mean_home", "mean_away", SEEN) + ["test as (select * from comps where season >= (select max(season) - 2 from contests))"]
_macro = lambda src: f"select variant, blend, count(*) as seasons, {r('avg(accuracy)', 'accuracy')}, {r('avg(rps)', 'rps')}, {r('avg(ph)', 'pred_home_share')} from (select variant, blend, season, avg(case when hit then 1.0 else 0.0 end) as accuracy, avg(rps) as rps, avg(case when pred = '1' then 1.0 else 0.0 end) as ph from {src} group by all) group by all"


def variants(name: str, extra_ctes: list[str], tests: dict[str, str], blends: dict[str, tuple[str, str, str]]) -> None:
    ctes, parts = list(extra_ctes), []
    for v, table in tests.items():
        for b, (f, m, o) in blends.items():
            t = f"b_{v}_{b}"
            ctes += blend(t, table, f, m, o)
            parts.append(f"select '{v}' as variant, '{b}' as blend, season, actual, p1, px, p2 from {t}")
    ctes += ["al as (" + " union all ".join(parts) + ")", *scored("sc", "al")]
    add(name, ctes, _macro("sc"))


_P = {"production": ("0.10", "0.0", "0.90")}
_alt = lambda name, q: [f"{name} as (select t.* exclude (q1, qx, q2), {q} from test t join contests c on c.league = t.league and c.match_seq = t.match_seq)"]
variants("shin_vs_proportional", FULL + ["test_p as (select t.* exclude (q1, qx, q2), (1/u1)/(1/u1+1/ux+1/u2) as q1, (1/ux)/(1/u1+1/ux+1/u2) as qx, (1/u2)/(1/u1+1/ux+1/u2) as q2 from test t join mk0 on mk0.league = t.league and mk0.match_seq = t.match_seq)"],
         {"shin": "test", "proportional": "test_p"}, _P)
_OPEN = shin("soo", "contests", ["o1", "ox", "o2"]) + ["test_o as (select t.* exclude (q1, qx, q2), s.p0 as q1, s.p1 as qx, s.p2 as q2 from test t join contests c on c.league = t.league and c.match_seq = t.match_seq join soo s using (o1, ox, o2))"]
variants("closing_vs_opening", FULL + _OPEN, {"closing": "test", "opening": "test_o"}, _P)
_PLAIN_TEST = PLAIN + ["""test_q as (select t.* exclude (xh_hist, xa_hist, xh_form, xa_form, xh_meet, xa_meet), h0 as xh_hist, a0 as xa_hist, case when h_form_venue_gf > 0 then h_form_venue_gf * greatest(a_form_ga, 0.3) / plain_away else h0 end as xh_form,
 case when a_form_venue_gf > 0 then a_form_venue_gf * greatest(h_form_ga, 0.3) / plain_home else a0 end as xa_form, case when met > 0 then met_gf / ((plain_home + plain_away) / 2) * plain_home else h0 end as xh_meet, case when met > 0 then met_ga / ((plain_home + plain_away) / 2) * plain_away else a0 end as xa_meet
 from test t join (select league, match_seq, plain_home, plain_away, met, met_gf, met_ga, h_form_venue_gf, a_form_venue_gf, h_form_ga, a_form_ga, h_gf_venue * a_ga_venue / plain_away as h0, a_gf_venue * h_ga_venue / plain_home as a0 from sta join pl using (league, season)) z using (league, match_seq))"""]
variants("league_mean_modes", FULL + _PLAIN_TEST, {"weighted": "test", "plain": "test_q"}, {**_P, "model": ("0.10", "0.0", "0.0")})
_cfg = lambda rows, names: "(values " + ", ".join("(" + ", ".join(d(v) if isinstance(v, float) else f"'{v}'" for v in row) + ")" for row in rows) + f") cfg({names})"
from ..plans import search as G  # noqa: E402  (the fixed grids only)

add("blend_weight_grid", FULL + [f"tc as (select test.*, f, o from test, {_cfg(G.blend_configs(), 'f, o')})"] + blend("bg", "tc", "f", "0.0", "o", extra=", f, o") + scored("sc", "bg"),
    f"select f as form, o as odds, count(*) as seasons, {r('avg(accuracy)', 'accuracy')}, {r('avg(rps)', 'rps')}, {r('avg(ph)', 'pred_home_share')} from (select f, o, season, avg(case when hit then 1.0 else 0.0 end) as accuracy, avg(rps) as rps, avg(case when pred = '1' then 1.0 else 0.0 end) as ph from sc group by all) group by all")

from .queries import CONFIGS  # noqa: E402  (the fixed weights only)

_mix = lambda x: f"greatest(0.05, case when wh + wf + wm + we > 0 then (wh * x{x}_hist + wf * x{x}_form + wm * x{x}_meet + we * x{x}_elo) / (wh + wf + wm + we) else x{x}_hist end) as x{x}"
add("configuration_table", FULL + RATED + ["rd as (select elo_home - elo_away as x, gh, ga from rated where elo_home is not null and elo_away is not null and season < (select max(season) - 2 from contests))"]
    + newton("fh", "gh") + newton("fa", "ga") + [
    "ce as (select t.*, r.elo_home - r.elo_away as dx from test t join rated r on r.league = t.league and r.match_seq = t.match_seq)",
    f"c0 as (select ce.*, f, m, o, e, dx is not null as elo_valid, exp(fh.b0 + fh.b1 * coalesce(dx, 0)) as xh_elo, exp(fa.b0 + fa.b1 * coalesce(dx, 0)) as xa_elo from ce, (select b0, b1 from fh where n = 12) fh, (select b0, b1 from fa where n = 12) fa, {_cfg(CONFIGS, 'f, m, o, e')})",
    "c1 as (select *, case when meet_valid then m else 0.0 end as m0, case when elo_valid then e else 0.0 end as e0 from c0)",
    "c2 as (select *, f + m0 + e0 + o as tt from c1)",
    "c3 as (select *, f / greatest(tt, 1.0) as wf, m0 / greatest(tt, 1.0) as wm, e0 / greatest(tt, 1.0) as we, o / greatest(tt, 1.0) as wq from c2)",
    "c4 as (select *, case when tt > 1 or abs(1 - wf - wm - we - wq) < 1e-12 then 0.0 else 1 - wf - wm - we - wq end as wh from c3)",
    f"c5 as (select f, m, o, e, season, actual, q1, qx, q2, wq, {_mix('h')}, {_mix('a')} from c4)",
    *grid("cg", "c5", "f, m, o, e, season, actual, q1, qx, q2, wq, xh, xa", "xh", "xa", "-0.1"),
    "cm as (select *, (1 - wq) * b1 + wq * q1 as p1, (1 - wq) * bx + wq * qx as px, (1 - wq) * b2 + wq * q2 as p2 from cg)", *scored("sc", "cm")],
    f"select {r('f', 'form')}, {r('m', 'meet')}, {r('o', 'odds')}, {r('e', 'elo')}, count(*) as n, {r('avg(case when hit then 1.0 else 0.0 end)', 'accuracy', 4)}, {r('avg(rps)', 'rps', 4)} from sc group by f, m, o, e")

# ------------------------------------------------------------------ comparisons
_pick = lambda s: f"case when p1_{s} >= px_{s} and p1_{s} >= p2_{s} then '1' when px_{s} >= p2_{s} then 'X' else '2' end"


def pair(name: str, source: str, extra: str = "league, match_seq") -> list[str]:
    return [f"{name} as (select {extra}, ({_pick('a')}) = actual as ok_a, ({_pick('b')}) = actual as ok_b, {RPS('p1_a', 'px_a')} as score_a, {RPS('p1_b', 'px_b')} as score_b from {source})"]


def report(source: str, by: str, cell: str = "match_seq * 5 + league", cells_: int = 1000, reps: int = 10000) -> list[str]:
    p = 2147483647
    mixed = f"(({cell}) * 48271 + 11) % {p}"
    cell = f"(({mixed}) * ({mixed}) + 7919) % {p}"
    steps, cdf, pmf = [], 0.0, math.exp(-1.0)
    for k in range(10):
        cdf += pmf
        pmf /= k + 1
        steps.append(f"(case when x >= {int(cdf * p)} then 1 else 0 end)")
    return [
        f"""cnt as (select {by}, count(*) as n, avg(case when ok_a then 1.0 else 0.0 end) as acc_a, avg(case when ok_b then 1.0 else 0.0 end) as acc_b, cast(sum(case when ok_a and not ok_b then 1 else 0 end) as bigint) as only_a,
 cast(sum(case when ok_b and not ok_a then 1 else 0 end) as bigint) as only_b, avg(score_a) as score_a, avg(score_b) as score_b from {source} group by {by})""",
        f"cl_ as (select {by}, ({cell}) % {cells_} as cell, sum(score_a - score_b) as s, count(*) as n from {source} group by {by}, ({cell}) % {cells_})",
        f"wt0 as (select cell, rep, (((cell * 48271 + 11) % {p}) * ((cell * 48271 + 11) % {p}) + rep * 69621) % {p} as x from (select unnest(range({cells_})) as cell) a, (select unnest(range(1, {reps + 1})) as rep) b)",
        f"wt1 as (select cell, rep, (x * x + rep + 12345) % {p} as x from wt0)", f"wt2 as (select cell, rep, (x * x + cell + 7919) % {p} as x from wt1)",
        f"wt as (select cell, rep, {' + '.join(steps)} as w from wt2)",
        f"bs as (select {by}, rep, sum(w * s) / sum(w * n) as m from cl_ join wt using (cell) group by {by}, rep)",
        f"ci as (select {by}, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high from bs group by {by})",
        f"""pv as (select {by}, case when only_a = only_b then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2.0))) from (select unnest(range(least(only_a, only_b) + 1)) as k))) end as p_value from cnt)""",
        f"""rep_ as (select {by}, n, acc_a, acc_b, only_a, only_b, score_a, score_b, ci_low, ci_high, p_value, only_a + only_b as discordant, score_a - score_b as diff,
 case when ci_low <= 0 and ci_high >= 0 then 'indistinguishable' when ci_high < 0 then 'better' else 'worse' end as verdict, case when p_value >= 0.05 then 'indistinguishable' when only_a > only_b then 'better' else 'worse' end as accuracy_verdict from cnt join ci using ({by}) join pv using ({by}))""",
    ]


REPORT = "n, only_a, only_b, discordant, verdict, accuracy_verdict, " + rs("acc_a", "acc_b", "score_a", "score_b", "ci_low", "ci_high", "p_value", "diff")
MVM = PROD + ["mv as (select league, match_seq, actual, p1 as p1_a, px as px_a, p2 as p2_a, q1 as p1_b, qx as px_b, q2 as p2_b from pd)"] + pair("pr", "mv")
SCOPES = ["ps as (select * , 'all' as scope from pr union all select *, cast(league as varchar) from pr)"]
add("paired_scores", once(MVM), f"select league, count(*) as n, {r('avg(case when ok_a then 1.0 else 0.0 end)', 'acc_a')}, {r('avg(case when ok_b then 1.0 else 0.0 end)', 'acc_b')}, cast(sum(case when ok_a and not ok_b then 1 else 0 end) as bigint) as only_a, cast(sum(case when ok_b and not ok_a then 1 else 0 end) as bigint) as only_b, {r('avg(score_a)', 'score_a')}, {r('avg(score_b)', 'score_b')} from pr group by league")
add("model_vs_market", MVM + SCOPES + report("ps", "scope"), f"select scope, {REPORT} from rep_")
_obin = "(p_{0} >= 0.5) = over_actual as ok_{0}, pow(p_{0} - (case when over_actual then 1.0 else 0.0 end), 2) as score_{0}"
OUV = E1 + OVER("oa", "0.1", "0.0")
add("over_under_vs_market", OUV + [f"pr as (select league, match_seq, {_obin.format('a')}, {_obin.format('b')} from (select *, bo as p_a, q_over as p_b from oa))"] + SCOPES + report("ps", "scope"), f"select scope, {REPORT} from rep_")
add("over_under_blend_sweep", OUV + [f"pr as (select league, match_seq, weight, {_obin.format('a')}, {_obin.format('b')} from (select *, (1 - weight) * bo + weight * q_over as p_a, q_over as p_b from oa, (values (0.0::double), (0.25), (0.5), (0.75), (0.9), (1.0)) w(weight)))"] + report("pr", "weight"),
    f"select {r('weight')}, {REPORT} from rep_")
_three = []
for i, (label, src, w) in enumerate((("closing vs opening", "test_o", ("0.10", "0.0", "0.90")), ("decayed vs plain means", "test_q", ("0.10", "0.0", "0.90")), ("model vs market", "test", ("0.0", "0.0", "1.0")))):
    _three += blend(f"alt{i}", src, *w)
add("configuration_differences", FULL + _OPEN + _PLAIN_TEST + blend("base", "test", "0.10", "0.0", "0.90") + _three + ["mv as (" + " union all ".join(
    f"select '{n}' as scope, a.league, a.match_seq, a.actual, a.p1 as p1_a, a.px as px_a, a.p2 as p2_a, b.p1 as p1_b, b.px as px_b, b.p2 as p2_b from base a join alt{i} b on b.league = a.league and b.match_seq = a.match_seq"
    for i, n in enumerate(("closing vs opening", "decayed vs plain means", "model vs market"))) + ")"] + pair("pr", "mv", "scope, league, match_seq") + report("pr", "scope"), f"select scope, {REPORT} from rep_")

# ------------------------------------------------------------------ search
_pairs = sorted({(f, m) for f, m, _, _ in G.model_configs()})
_SEARCH = E1 + [f"s0 as (select comps.*, f, ms from comps, {_cfg(_pairs, 'f, ms')})",
    "s1 as (select *, case when meet_valid then ms else 0.0 end as me from s0)",
    "s2 as (select *, greatest(0.05, (greatest(0, 1 - f - me) * xh_hist + f * xh_form + me * xh_meet) / (greatest(0, 1 - f - me) + f + me)) as l, greatest(0.05, (greatest(0, 1 - f - me) * xa_hist + f * xa_form + me * xa_meet) / (greatest(0, 1 - f - me) + f + me)) as m from s1)"]
for _i, _rho in enumerate(G.RHO_GRID):
    _SEARCH += grid(f"sg{_i}", "s2", "f, ms, actual, over_actual, q1, qx, q2, q_over", "l", "m", repr(_rho))
_SEARCH += ["sg as (" + " union all ".join(f"select *, {d(_rho)} as rho from sg{_i}" for _i, _rho in enumerate(G.RHO_GRID)) + ")",
    f"sw as (select f as form, ms as meet, w as odds, rho, actual, over_actual, (1 - w) * b1 + w * q1 as p1, (1 - w) * bx + w * qx as px, (1 - w) * b2 + w * q2 as p2, (1 - w) * bo + w * q_over as po from sg, {_cfg([(o,) for o in G.ODDS_GRID], 'w')} where f + ms + w <= 1.0001)",
    "sk as (select form, meet, odds, rho, greatest(p1, px, p2) as cr, (case when p1 >= px and p1 >= p2 then '1' when px >= p2 then 'X' else '2' end) = actual as kr, greatest(po, 1 - po) as ct, (po >= 0.5) = over_actual as kt from sw)",
    "sm as (select form, meet, odds, rho, '1X2' as market, cr as conf, kr as ok from sk union all select form, meet, odds, rho, 'Over/Under', ct, kt from sk union all select form, meet, odds, rho, 'both', greatest(cr, ct), case when ct > cr then kt else kr end from sk)",
    "sb as (select form, meet, odds, rho, market, (conf >= 0.55)::int + (conf >= 0.6)::int + (conf >= 0.65)::int + (conf >= 0.7)::int + (conf >= 0.75)::int as band, case when conf >= 0.5 and conf < 1 then floor((conf - 0.5) / 0.05 + 1e-9) else -1 end as bin, count(*) as n, sum(ok::int) as ok, sum(conf) as conf, sum(pow(conf - ok::int, 2)) as sq from sm group by all)",
    "st_ as (select form, meet, odds, rho, market, sum(n) as alln from sb group by all)",
    f"sr as (select form, meet, odds, rho, market, threshold, bin, sum(n) as n, sum(ok) as ok, sum(conf) as conf, sum(sq) as sq from sb, {_cfg([(float(i + 1), t) for i, t in enumerate(G.THRESHOLDS)], 'need, threshold')} where band >= need group by all)",
    "sf as (select form, meet, odds, rho, market, threshold, sum(n) as n, sum(ok) as ok, sum(conf) as conf, sum(sq) as sq, sum(case when bin >= 0 and n >= 50 then abs(conf / n - ok / n) * n end) as gap, sum(case when bin >= 0 and n >= 50 then n end) as gn from sr group by all having sum(n) >= 39)",
    "search as (select form, meet, odds, rho, market, threshold, cast(n as bigint) as n_selected, n / alln as share_selected, ok / n as hit_rate, conf / n as declared, gap / gn as calibration_gap, conf / n - ok / n as bias, pow(ok / n, 13) as p_slip_13, sq / n as brier from sf join st_ using (form, meet, odds, rho, market))"]
add("configuration_search", _SEARCH, f"select {rs('form', 'meet', 'odds', 'rho', 'threshold')}, market, n_selected, {rs('share_selected', 'hit_rate', 'declared', 'calibration_gap', 'bias', 'p_slip_13', 'brier')} from search")

# ------------------------------------------------------------------ slips
add("fixture_validation", CONTESTS + ["""fx as (select match_seq, match_seq % 61 = 0 as void, case when match_seq % 61 = 0 or match_seq % 53 = 1 then null else home end as h, case when match_seq % 61 = 0 then null when match_seq % 47 = 2 then home else away end as a,
 case when match_seq % 61 = 0 or match_seq % 43 = 3 then null else o1 end as f1, case when match_seq % 61 = 0 then null when match_seq % 41 = 4 then 0.95 else ox end as fx from contests)"""],
    "select case when h is null or a is null then 'both teams needed' when h = a then 'same team twice' when f1 is null or fx is null then 'odds missing' when fx <= 1 then 'odds must exceed one' else 'valid' end as reason, count(*) as n, cast(sum(match_seq) as bigint) as sum_seq from fx where not void group by 1")
PICKS = E1 + ["""pk0 as (select c.*, u1 as o1, ux as ox, u2 as o2, oover, ounder, case when q1 >= qx and q1 >= q2 then '1' when qx >= q2 then 'X' else '2' end as p0, greatest(q1, qx, q2) as c0, greatest(q_over, 1 - q_over) as c9 from comps c join mk0 t on t.league = c.league and t.match_seq = c.match_seq)""",
    """pk as (select league, season, match_seq, date_trunc('week', d)::date as week, case when c9 > c0 then 'Over/Under 2.5' else '1X2' end as market, case when c9 > c0 then (case when q_over >= 0.5 then 'Over 2.5' else 'Under 2.5' end) else p0 end as pick, greatest(c0, c9) as confidence,
 case when c9 > c0 then (case when q_over >= 0.5 then oover else ounder end) else (case p0 when '1' then o1 when 'X' then ox else o2 end) end as pick_odds, case when c9 > c0 then 1/oover + 1/ounder - 1 else 1/o1 + 1/ox + 1/o2 - 1 end as margin,
 case when c9 > c0 then (q_over >= 0.5) = over_actual else p0 = actual end as hit from pk0)"""]
add("slip_picks", PICKS, f"select {KEY}, market, pick, {rs('confidence', 'pick_odds', 'margin')}, case when hit then 1 else 0 end as hit from pk")
_SEL = PICKS + ["sl as (select *, round(confidence, 9) as cf, row_number() over (partition by week order by round(confidence, 9) desc, league, match_seq) as place, row_number() over (partition by week, round(confidence, 9) >= 0.55 order by round(confidence, 9) desc, league, match_seq) as place2 from pk)"]
add("slip_selection", _SEL, f"select cast(week as varchar) as week, count(*) as n, cast(sum(case when cf >= 0.55 and place2 <= 13 then 1 else 0 end) as bigint) as selected, {r('min(case when cf >= 0.55 and place2 <= 13 then cf end)', 'lowest')}, {r('cast(sum(case when cf >= 0.55 and place2 <= 13 then match_seq end) as double)', 'sum_seq')} from sl group by week")
add("slip_summary", _SEL + ["t13 as (select * from sl where place <= 13)"],
    f"""select cast(week as varchar) as week, count(*) as n_matches, {r('sum(ln(pick_odds))', 'multiplier')}, {r('product(cf)', 'p_all')}, {r('avg(cf)', 'mean_confidence')}, {r('avg(margin)', 'mean_margin')}, {r('-sum(ln(cf))', 'one_in')},
 {r('product(cf) * (1 + sum((1 - cf) / cf))', 'p_at_least_n_minus_1')}, {r('product(pick_odds) * product(cf)', 'expected_return')}, {r('sum(cf)', 'expected_hits')} from t13 group by week""")
add("latest_round", CONTESTS, f"select {KEY}, {DAY}, home, away, {rs('c1', 'oover')} from contests where c1 is not null and oover > 1 and ounder > 1 order by d desc, match_seq desc, league limit 20")

# the three highest numbers below a full slip from power sums of the odds against each pick
add("slip_hits_tail", _SEL + ["t13 as (select *, (1 - cf) / cf as against from sl where place <= 13)",
    "tl as (select week, count(*) as n, product(cf) as p, sum(against) as s1, sum(pow(against, 2)) as s2, sum(pow(against, 3)) as s3 from t13 group by week)"],
    f"select cast(week as varchar) as week, n as n_matches, cast(n - k as int) as hits, {r('p * (case k when 0 then 1 when 1 then s1 when 2 then (s1 * s1 - s2) / 2 else (s1 * s1 * s1 - 3 * s1 * s2 + 2 * s3) / 6 end)', 'probability')} from tl, (select unnest(range(4)) as k) where n - k >= 0")
add("weekly_slip_backtest", PICKS + ["""md as (select 'both' as markets, week, league, match_seq, round(confidence, 9) as cf, hit from pk
 union all select '1X2', date_trunc('week', d)::date, league, match_seq, round(c0, 9), p0 = actual from pk0
 union all select 'Over/Under', date_trunc('week', d)::date, league, match_seq, round(c9, 9), (q_over >= 0.5) = over_actual from pk0)""",
    "mr as (select *, row_number() over (partition by markets, week order by cf desc, league, match_seq) as place from md)",
    "mw as (select markets, week, count(*) as n, product(cf) as declared, min(hit::int) as all_hit, sum(hit::int) as hits from mr where place <= 13 group by markets, week)"],
    f"""select markets, count(*) as slips, cast(sum(all_hit) as bigint) as "full", {r('avg(all_hit)', 'observed')}, {r('avg(declared)', 'declared')}, {r('avg(hits)', 'mean_hits')} from mw where n = 13 group by markets""")
add("search_best", _SEARCH, f"select {rs('form', 'meet', 'odds', 'rho', 'threshold')}, market, n_selected, {rs('share_selected', 'hit_rate', 'declared', 'calibration_gap', 'bias', 'brier')} from (select * replace (round(hit_rate, 9) as hit_rate) from search) where share_selected >= 0.25 order by hit_rate desc nulls last, form, meet, odds, rho, market, threshold limit 10")
add("search_marginals", _SEARCH + ["sv as materialized (select * from search)"], " union all ".join(
    f"select '{p}' as parameter, cast({p} as varchar) as value, count(*) as configs, {r('avg(hit_rate)', 'hit_rate')}, {r('avg(calibration_gap)', 'calibration_gap')} from sv group by {p}" for p in G.PARAMETERS))
add("over_under_analysis", CONTESTS + shin("su", "contests", ["oover", "ounder"]) + [
    "ou as (select c.*, su.p0 as market, 0.5 * (match_seq % 10) / 10.0 + 0.5 * su.p0 as mixed from contests c join su using (oover, ounder))"],
    f"""select {KEY}, {r('market', 'prob_over_market')}, {r('market', 'prob_over')}, {r('1 - market', 'prob_under')}, case when market >= 1 - market then 'Over 2.5' else 'Under 2.5' end as ou_pick, {r('greatest(market, 1 - market)', 'ou_confidence')},
 {r('case when market >= 1 - market then oover else ounder end', 'ou_pick_odds')}, {r('1 / oover + 1 / ounder - 1', 'ou_margin')}, case when mixed >= 1 - mixed then 'Over 2.5' else 'Under 2.5' end as blend_pick, {r('greatest(mixed, 1 - mixed)', 'blend_confidence')} from ou""")


def _power(x: str, k: int) -> str:
    """x^k / k! as a chain of products, so that equal scores tie exactly."""
    out = "1.0"
    for i in range(1, k + 1):
        out = f"({out} * {x} / {i})"
    return out


_goals = ", ".join(f"{{'i': {i}, 'x': {_power('l', i)}}}" for i in range(11))
_goals_away = ", ".join(f"{{'j': {j}, 'y': {_power('m', j)}}}" for j in range(11))
add("top_scores", E1 + ["ts0 as (select league, match_seq, cast(greatest(round(xh_hist + 1e-9::double, 3), 0.05) as double) as l, cast(greatest(round(xa_hist + 1e-9::double, 3), 0.05) as double) as m from comps)",
    f"ts1 as (select league, match_seq, l, m, least(greatest(-0.1, greatest(-1 / l, -1 / m)), least(1 / (l * m), 1.0)) as rho, [{_goals}] as hs, [{_goals_away}] as gs from ts0)",
    "ts2 as (select *, list_sum(list_transform(hs, lambda a: a.x)) * list_sum(list_transform(gs, lambda a: a.y)) as total, unnest(hs) as h from ts1)",
    "ts3 as (select league, match_seq, l, m, rho, total, h.i as i, h.x as x, unnest(gs) as g from ts2)",
    """ts4 as (select league, match_seq, i, g.j as j, x * g.y * (case when i = 0 and g.j = 0 then 1 - l * m * rho when i = 0 and g.j = 1 then 1 + l * rho when i = 1 and g.j = 0 then 1 + m * rho when i = 1 and g.j = 1 then 1 - rho else 1.0 end) / total as p from ts3)""",
    "ts5 as (select *, row_number() over (partition by league, match_seq order by round(p, 12) desc, i, j) - 1 as place from ts4 qualify place < 5)"],
    f"select cast(place as int) as place, i || '-' || j as score, count(*) as n, {r('avg(p)', 'p')} from ts5 group by place, i, j")
add("meeting_prices", CONTESTS + ["""mp0 as (select *, coalesce(list({'home': home, 'h': coalesce(c1, o1), 'd': coalesce(cx, ox), 'a': coalesce(c2, o2)}) over (partition by league, least(home, away), greatest(home, away) order by match_seq rows between 10 preceding and 1 preceding), []) as met0 from contests)""",
    "mp1 as (select *, case when len(list_filter(met0, lambda x: x.home = home)) > 0 then list_filter(met0, lambda x: x.home = home) else met0 end as used from mp0)",
    "mp2 as materialized (select *, len(used) as k, " + ", ".join(f"case when len(used) > 0 then len(used) / list_sum(list_transform(used, lambda x: 1.0 / {v})) end as {n}" for n, v in (
        ("e1", "(case when x.home = home then x.h else x.a end)"), ("ex", "x.d"), ("e2", "(case when x.home = home then x.a else x.h end)"))) + " from mp1)",
    *shin("sm_", "mp2", ["e1", "ex", "e2"])],
    f"select {KEY}, {DAY}, home, away, cast(len(met0) as int) as met, cast(k as int) as priced, {r('p0', 'q1')}, {r('p1', 'qx')}, {r('p2', 'q2')} from mp2 left join sm_ using (e1, ex, e2)")

# ------------------------------------------------------------------ forecasts of fixtures
_LAST = "(select max(season) from contests)"
_price = lambda c: f"case when max(match_seq) % 3 <> 0 then max_by({c}, match_seq) end as {c}"
FIXTURES = CONTESTS + [
    f"fx as (select league, home, away, max(match_seq) as match_seq, {', '.join(_price(c) for c in ('o1', 'ox', 'o2', 'oover', 'ounder'))} from contests where season = {_LAST} group by league, home, away)",
    f"seen as (select league, home as team from contests where season < {_LAST} union select league, away from contests where season < {_LAST})",
    """fk as (select *, (select count(*) from seen s where s.league = fx.league and s.team = fx.home) > 0 and (select count(*) from seen s where s.league = fx.league and s.team = fx.away) > 0 as known from fx)"""]
_venue_form = lambda v: f"coalesce(avg(gf) filter (where venue = '{v}' and k_venue <= 3), 0)"
_ratio = lambda g, v: f"coalesce(sum(e * {g}) filter (where venue = '{v}') / sum(e) filter (where venue = '{v}'), 0)"
_FORECAST = FIXTURES + APP + [
    f"ha as (select *, row_number() over (partition by league, team order by match_seq desc) as k_all, row_number() over (partition by league, team, venue order by match_seq desc) as k_venue from app where season < {_LAST})",
    f"""tf as (select league, team, {_ratio('gf', 'H')} as att_home, {_ratio('ga', 'H')} as def_home, {_ratio('gf', 'A')} as att_away, {_ratio('ga', 'A')} as def_away,
 avg(gf) filter (where k_all <= 3) as form_gf, avg(ga) filter (where k_all <= 3) as form_ga, {_venue_form('H')} as form_home, {_venue_form('A')} as form_away from ha group by league, team)""",
    "mf as (select league, sum(e * gf) / sum(e) as mh, sum(e * ga) / sum(e) as ma from ha where venue = 'H' group by league)",
    f"pm as (select *, row_number() over (partition by league, least(home, away), greatest(home, away) order by match_seq desc) as k from contests where season < {_LAST})",
    "pl_ as (select league, least(home, away) as lo, greatest(home, away) as hi, list({'home': home, 'gh': gh, 'ga': ga, 'h': coalesce(c1, o1), 'd': coalesce(cx, ox), 'a': coalesce(c2, o2)} order by match_seq) as met0 from pm where k <= 10 group by all)",
    "f0_ as (select f.*, coalesce(met0, []) as met0, list_transform(coalesce(met0, []), lambda x: case when x.home = f.home then x.gh - x.ga else x.ga - x.gh end) as lead from fk f left join pl_ p on p.league = f.league and p.lo = least(f.home, f.away) and p.hi = greatest(f.home, f.away) where known)",
    "f1_ as (select *, case when len(list_filter(met0, lambda x: x.home = home)) > 0 then list_filter(met0, lambda x: x.home = home) else met0 end as used from f0_)",
    "f2_ as materialized (select *, " + ", ".join(f"case when len(used) > 0 then len(used) / list_sum(list_transform(used, lambda x: 1.0 / {v})) end as {n}" for n, v in (
        ("e1", "(case when x.home = home then x.h else x.a end)"), ("ex", "x.d"), ("e2", "(case when x.home = home then x.a else x.h end)"))) + " from f1_)",
    *shin("fm_", "f2_", ["e1", "ex", "e2"]), *shin("fo_", "fk", ["o1", "ox", "o2"]),
    """f3_ as (select f.*, coalesce(o.p0, m.p0) as q1, coalesce(o.p1, m.p1) as qx, coalesce(o.p2, m.p2) as q2 from f2_ f left join fm_ m on m.e1 = f.e1 and m.ex = f.ex and m.e2 = f.e2
 left join fo_ o on o.o1 = f.o1 and o.ox = f.ox and o.o2 = f.o2 and least(f.o1, f.ox, f.o2) > 1)""",
    """f4_ as (select f.*, len(met0) as met, list_sum(list_transform(met0, lambda x: case when x.home = f.home then x.gh else x.ga end)) / len(met0) as met_gf, list_sum(list_transform(met0, lambda x: case when x.home = f.home then x.ga else x.gh end)) / len(met0) as met_ga,
 len(list_filter(lead, lambda x: x > 0)) as met_won, len(list_filter(lead, lambda x: x = 0)) as met_drawn, len(list_filter(lead, lambda x: x < 0)) as met_lost,
 h.att_home * a.def_away / ma as hh, a.att_away * h.def_home / mh as ah, case when h.form_home > 0 then h.form_home * greatest(a.form_ga, 0.3) / ma end as hf, case when a.form_away > 0 then a.form_away * greatest(h.form_ga, 0.3) / mh end as af, mh, ma
 from f3_ f join tf h on h.league = f.league and h.team = f.home join tf a on a.league = f.league and a.team = f.away join mf on mf.league = f.league)""",
    # 0.3 form, 0.2 meetings, 0.4 market: history takes the rest and what has no meetings or prices
    """f5_ as (select *, case when met > 0 then 0.2::double else 0 end as wm, case when q1 is null then 0::double else 0.4 end as wq, coalesce(hf, hh) as hf_, coalesce(af, ah) as af_,
 case when met > 0 then met_gf / ((mh + ma) / 2) * mh else hh end as hm, case when met > 0 then met_ga / ((mh + ma) / 2) * ma else ah end as am from f4_)""",
    "f6_ as (select *, ((0.7 - wm - wq) * hh + 0.3 * hf_ + wm * hm) / (1.0 - wq) as xh, ((0.7 - wm - wq) * ah + 0.3 * af_ + wm * am) / (1.0 - wq) as xa from f5_)",
    f"f7_ as (select *, ({cells('xh', 'xa', lambda i, j: i + j > 1)}) as over_one, ({cells('xh', 'xa', lambda i, j: True)}) as whole, xh * xa * least(greatest(-0.1, greatest(-1 / xh, -1 / xa)), least(1 / (xh * xa), 1.0)) as shift from f6_)",
    *grid("f8_", "f7_", "*", "xh", "xa", "-0.1")]
add("fixture_forecasts", _FORECAST, f"""select league, home, away, {rs('xh', 'xa')}, {r('(1 - wq) * b1 + wq * coalesce(q1, 0)', 'p1')}, {r('(1 - wq) * bx + wq * coalesce(qx, 0)', 'px')}, {r('(1 - wq) * b2 + wq * coalesce(q2, 0)', 'p2')},
 {r('b1', 'p1_base')}, {r('bx', 'px_base')}, {r('b2', 'p2_base')}, case when q1 is null then 0 else 1 end as has_odds, {r('(over_one - shift) / whole', 'over15')}, {r('bo', 'over25')}, {r('1 - bo', 'under25')}, {r('xh + xa', 'goals')},
 cast(met as int) as met, {rs('met_gf', 'met_ga')}, cast(met_won as int) as met_won, cast(met_drawn as int) as met_drawn, cast(met_lost as int) as met_lost, cast(null as varchar) as reason from f8_
 union all select league, home, away, {', '.join('null' for _ in range(8))}, null, {', '.join('null' for _ in range(4))}, null, null, null, null, null, null, 'no history for a team' from fk where not known""")
# with all weight on the market a slip's probabilities are those of the fixtures' own prices
_BUILT = FIXTURES + shin("bo_", "fk", ["o1", "ox", "o2"]) + shin("bu_", "fk", ["oover", "ounder"]) + [
    "b0_ as (select f.*, s.p0 as q1, s.p1 as qx, s.p2 as q2, case when least(oover, ounder) > 1 then u.p0 end as qo from fk f join bo_ s using (o1, ox, o2) left join bu_ u using (oover, ounder) where known and least(o1, ox, o2) > 1)",
    "b1_ as (select *, greatest(q1, qx, q2) as cr, case when q1 >= qx and q1 >= q2 then o1 when qx >= q2 then ox else o2 end as pr, coalesce(greatest(qo, 1 - qo), 0) as ct from b0_)",
    "b2_ as (select league, match_seq, greatest(cr, ct) as cf, case when ct > cr then case when qo >= 0.5 then oover else ounder end else pr end as price, case when ct > cr then 1 / oover + 1 / ounder - 1 else 1 / o1 + 1 / ox + 1 / o2 - 1 end as margin from b1_)",
    "b3_ as (select * from b2_ where cf >= 0.55 qualify row_number() over (partition by league order by cf desc, match_seq) <= 13)"]
add("slip_builder", _BUILT, f"""select league, count(*) as n_matches, {r('sum(ln(price))', 'multiplier')}, {r('product(cf)', 'p_all')}, {r('avg(cf)', 'mean_confidence')}, {r('avg(margin)', 'mean_margin')}, {r('-sum(ln(cf))', 'one_in')},
 {r('product(cf) * (1 + sum((1 - cf) / cf))', 'p_at_least_n_minus_1')}, {r('product(price) * product(cf)', 'expected_return')} from b3_ group by league""")

# ------------------------------------------------------------------ power
_tail = lambda k, m: f"least(1.0, 2 * list_sum(list_transform(range(greatest(0, {m} - cast(6 * sqrt({k}) as bigint) - 60), {m} + 1), lambda j: exp(lgamma({k} + 1) - lgamma(j + 1) - lgamma({k} - j + 1) - {k} * ln(2.0::double)))))"
_POWER = E1 + [f"cw as (select comps.*, w from comps, {_cfg([(w,) for w in (0.02, 0.05, 0.10, 0.15, 0.20)], 'w')})"] + blend("pw", "cw", "w", "0.0", "(1 - w)", extra=", w") + [
    "mv as (select w as weight, league, match_seq, actual, p1 as p1_a, px as px_a, p2 as p2_a, q1 as p1_b, qx as px_b, q2 as p2_b from pw)"] + pair("pr", "mv", "weight, league, match_seq") + report("pr", "weight, league") + [
    "pn as (select *, cast(only_a as double) / discordant as share, abs(only_a - only_b) / cast(discordant as double) as lean from rep_ where only_a <> only_b and p_value >= 0.05)",
    # the normal approximation is off by less than 8 / sqrt(k) standard deviations: sizes outside can't be the first
    "pk_ as (select weight, league, n, discordant, share, unnest(range(greatest(discordant + 1, cast(pow(greatest(1.95 / lean - 8 / 1.95, 0), 2) as bigint)), cast(pow(1.97 / lean + 8, 2) as bigint) + 80)) as k from pn)",
    "pt as (select *, cast(round_even(k * share, 0) as bigint) as ka from pk_)",
    f"pv_ as (select weight, league, n, discordant, k, {_tail('k', 'least(ka, k - ka)')} as p from pt)",
    "pf as (select weight, league, min_by(cast(round_even(k / (discordant / cast(n as double)), 0) as bigint), k) as needed from pv_ where p < 0.05 group by weight, league)"]
add("power_needed", _POWER, f"""select {r('weight')}, league, n, only_a, only_b, case when diff <> 0 and ci_low <= 0 and ci_high >= 0 then cast(round_even(n * pow((ci_high - ci_low) / 2 / abs(diff), 2), 0) as bigint) else -1 end as needed_score,
 coalesce(needed, -1) as needed_accuracy from rep_ left join pf using (weight, league)""")

# ------------------------------------------------------------------ external goals: earlier days only
_days = "range between unbounded preceding and interval 1 day preceding"
_pool = lambda x: f"(list_sum(list_transform(list_concat(lh, la), lambda z: z.{x})) / nullif(len(lh) + len(la), 0))"
_EXTERNAL = FULL + [
    "ext as (select team, d, venue, 0.3 + 0.8 * avg(gf) as xg from app where not (team % 11 = 3 and venue = 'A') group by team, d, venue)",
    """cov as (select c.league, c.match_seq, c.d, c.home, c.away, h.xg as gh, a.xg as ga, pow(2, datediff('day', date '1998-01-01', c.d) / 730.0) as e
 from contests c join ext h on h.team = c.home and h.d = c.d and h.venue = 'H' join ext a on a.team = c.away and a.d = c.d and a.venue = 'A')""",
    f"xl as (select *, avg(gh) over w as run_home, avg(ga) over w as run_away from cov window w as (partition by league order by d {_days}))",
    "xa_ as (select league, match_seq, d, home as team, 'H' as venue, gh as gf, ga, e from cov union all select league, match_seq, d, away, 'A', ga, gh, e from cov)",
    f"""xt0 as (select *, coalesce(sum(e * gf) over v / sum(e) over v, 0) as gf_venue, coalesce(sum(e * ga) over v / sum(e) over v, 0) as ga_venue, count(*) over t as n_prior,
 list({{'s': match_seq, 'gf': gf, 'ga': ga}}) filter (where venue = 'H') over t as l_h, list({{'s': match_seq, 'gf': gf, 'ga': ga}}) filter (where venue = 'A') over t as l_a
 from xa_ window v as (partition by league, team, venue order by d {_days}), t as (partition by league, team order by d {_days}))""",
    "xt1 as (select * exclude (l_h, l_a), coalesce(list_sort(l_h)[-3:], []) as lh, coalesce(list_sort(l_a)[-3:], []) as la from xt0)",
    f"""xt as (select league, match_seq, venue, gf_venue, ga_venue, n_prior, coalesce({_pool('ga')}, 0) as form_ga,
 coalesce(list_avg(list_transform(case when venue = 'H' then lh else la end, lambda z: z.gf)), 0) as form_venue_gf from xt1)""",
    """xc0 as (select l.league, l.match_seq, run_home as mh, run_away as ma, h.gf_venue * a.ga_venue / run_away as hh, a.gf_venue * h.ga_venue / run_home as ah, h.form_venue_gf as hv, a.form_venue_gf as av, h.form_ga as hg, a.form_ga as ag
 from xl l join xt h on h.league = l.league and h.match_seq = l.match_seq and h.venue = 'H' join xt a on a.league = l.league and a.match_seq = l.match_seq and a.venue = 'A' where h.n_prior > 0 and a.n_prior > 0)""",
    "xc as (select league, match_seq, hh, ah, case when hv > 0 then hv * greatest(ag, 0.3) / ma else hh end as hf, case when av > 0 then av * greatest(hg, 0.3) / mh else ah end as af from xc0)",
    "test_r as (select t.* from test t join xc using (league, match_seq))",
    "test_x as (select t.* exclude (xh_hist, xa_hist, xh_form, xa_form), x.hh as xh_hist, x.ah as xa_hist, x.hf as xh_form, x.af as xa_form from test t join xc x on x.league = t.league and x.match_seq = t.match_seq)"]
add("external_goals_backtest", _EXTERNAL + blend("br", "test_r", "0.10", "0.0", "0.90") + blend("bx_", "test_x", "0.10", "0.0", "0.90") + [
    "al as (select 'goals' as model, season, actual, p1, px, p2 from br union all select 'external', season, actual, p1, px, p2 from bx_)", *scored("sc", "al")],
    f"select model, season, {METRICS} from sc group by model, season")
