"""Walk-forward state of both teams before each match.

Every feature of a match uses rows with a smaller ``match_seq`` only. With a bounded frame
(``lookback`` rows of the league) all windows of the build share one shuffle by (league, block):
league means, meetings of the pair, venue strengths, recent form. Over all history the same
features come from sums and last-n rows that earlier blocks leave, joined to the block as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.odds import div
from .blocks import block_of, dealt_by_cell, earlier_rows, tasks_for, with_halo

LOOKBACK = 1600
HALF_LIFE = 730.0
MAX_EXPONENT = 900.0
# Half-lives of one span of weights: the square of its growth still fits a double.
SPAN = 450

TEAM_FIELDS = ["n_prior", "gf_venue", "ga_venue", "form_n", "form_gf", "form_ga",
               "form_venue_n", "form_venue_gf"]
LEAGUE_FIELDS = ["n_league", "mean_home", "mean_away"]
MEETING_FIELDS = ["met", "met_gf", "met_ga"]


def growth(date: Column, epoch: Column, half_life: float | None, span: Column | None = None) -> Column:
    """``2 ** (age of the epoch / half_life)``.

    The weight ``0.5 ** ((ref - d) / h)`` of a match is this value times a factor of ``ref`` alone,
    which cancels in any weighted mean; so one pass of sums serves every reference date. A span of
    more than 900 half-lives does not fit a double and fails loudly.
    """
    if half_life is None or half_life <= 0:
        return F.lit(1.0)
    days = F.datediff(date, epoch).cast("double") / F.lit(float(half_life))
    g = F.pow(F.lit(2.0), days)
    if span is None:
        return g
    message = F.lit("half-life too short for the time span of a block; use the fixed-reference aggregates")
    return F.when(span / F.lit(float(half_life)) <= MAX_EXPONENT, g).otherwise(F.raise_error(message).cast("double"))


def spanned_growth(date: Column, epoch: Column, half_life: float | None) -> tuple[Column, Column]:
    """The span of ``SPAN`` half-lives a date falls into, and the growth since the span's begin."""
    if half_life is None or half_life <= 0:
        return F.lit(0).cast("long"), F.lit(1.0)
    ages = F.datediff(date, epoch).cast("double") / F.lit(float(half_life))
    span = F.floor(ages / F.lit(float(SPAN)))
    return span, F.pow(F.lit(2.0), ages - span * F.lit(float(SPAN)))


def appearances(matches: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two rows per match: each team with its opponent, venue and goals for and against."""
    def side(team: str, opp: str, venue: str, gf: str, ga: str) -> Column:
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.lit(venue).alias("venue"),
                        F.col(gf).alias("gf"), F.col(ga).alias("ga"))

    both = F.explode(F.array(side("home", "away", "H", "gh", "ga"), side("away", "home", "A", "ga", "gh")))
    return matches.select("league", "season", "match_seq", "d", *extra, both.alias("_s")).select(
        "league", "season", "match_seq", "d", *extra, "_s.*")


def _sum_of(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[field].cast("double"))


def _meetings(items: Column) -> list[Column]:
    """Count and mean goals of past meetings, seen from the home team of the current match."""
    n = F.size(items)
    scored = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.when(x["home"] == F.col("home"), x["gh"]).otherwise(x["ga"]).cast("double"))
    conceded = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.when(x["home"] == F.col("home"), x["ga"]).otherwise(x["gh"]).cast("double"))
    return [n.alias("met"), F.when(n > 0, scored / n).alias("met_gf"), F.when(n > 0, conceded / n).alias("met_ga")]


def pair_columns() -> list[Column]:
    return [F.least("home", "away").alias("_lo"), F.greatest("home", "away").alias("_hi")]


def _form_columns(own: Column, home_rows: Column, away_rows: Column) -> list[Column]:
    n = (F.size(home_rows) + F.size(away_rows)).cast("double")
    k = F.size(own).cast("double")

    def mean(total: Column, count: Column) -> Column:
        return F.when(count > 0, total / count).otherwise(F.lit(0.0))

    return [n.cast("int").alias("form_n"),
            mean(_sum_of(home_rows, "gf") + _sum_of(away_rows, "gf"), n).alias("form_gf"),
            mean(_sum_of(home_rows, "ga") + _sum_of(away_rows, "ga"), n).alias("form_ga"),
            k.cast("int").alias("form_venue_n"), mean(_sum_of(own, "gf"), k).alias("form_venue_gf")]


def bounded_state(matches: DataFrame, lookback: int = LOOKBACK, half_life: float | None = HALF_LIFE, n_form: int = 3,
                  n_meet: int = 10, block_rows: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """State of both teams over the last ``lookback`` matches of the league.

    ``matches`` needs league, season, match_seq (dense per league), d, home, away, gh, ga. Returns one
    row per match with the league, meeting and team fields (``h_`` home team, ``a_`` away team) and
    the ``carry`` columns. A task holds some blocks of ``block_rows`` + ``lookback`` matches, 50,000 or so
    in all: there are as many tasks as that takes.
    """
    size = block_rows or 8 * lookback
    tasks = tasks_for(matches.count() * (size + lookback) // size, size + lookback)
    m = with_halo(matches.select("league", "season", "match_seq", "d", "home", "away", "gh", "ga", *carry),
                  "match_seq", size, lookback).repartition(tasks, "league", "block")
    whole = W.partitionBy("league", "block")
    along = whole.orderBy("match_seq")
    span = F.datediff(F.max("d").over(whole), F.min("d").over(whole)).cast("double")
    m = m.select("*", F.min("d").over(whole).alias("_epoch"), span.alias("_span"))
    m = m.withColumn("_e", growth(F.col("d"), F.col("_epoch"), half_life, F.col("_span")))

    # league sums of the frame as a difference of two prefix sums: constant work per row
    prefix = along.rowsBetween(W.unboundedPreceding, 0)
    sums = {"w": F.col("_e"), "h": F.col("_e") * F.col("gh"), "a": F.col("_e") * F.col("ga")}
    m = m.select("*", *[F.sum(v).over(prefix).alias(f"_c{n}") for n, v in sums.items()])
    m = m.select("*", *[(F.lag(f"_c{n}", 1, 0.0).over(along) - F.lag(f"_c{n}", lookback + 1, 0.0).over(along)).alias(f"_f{n}")
                        for n in sums])
    reach = F.col("match_seq") - F.lit(lookback)
    pair = W.partitionBy("league", "block", "_lo", "_hi").orderBy("match_seq").rowsBetween(-n_meet, -1)
    m = m.select("*", *pair_columns())
    m = m.withColumn("_met", F.collect_list(F.struct("match_seq", "home", "gh", "ga")).over(pair))
    m = m.withColumn("_met", F.filter("_met", lambda x: x["match_seq"] >= reach))
    m = m.select("league", "block", "halo", "season", "match_seq", "d", "home", "away", "gh", "ga", "_e", *carry,
                 F.least(F.col("match_seq"), F.lit(lookback)).alias("n_league"),
                 div("_fh", "_fw").alias("mean_home"), div("_fa", "_fw").alias("mean_away"),
                 *_meetings(F.col("_met")))

    kept = [*carry, *LEAGUE_FIELDS, *MEETING_FIELDS]

    def side(team: str, opp: str, venue: str, gf: str, ga: str) -> Column:
        mine = venue == "H"
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opp"), F.lit(venue).alias("venue"),
                        F.col(gf).alias("gf"), F.col(ga).alias("ga"),
                        *[(F.when(~F.col("halo"), F.col(c)) if mine else F.lit(None).cast(m.schema[c].dataType)).alias(c) for c in kept])

    rows = m.select("league", "block", "halo", "season", "match_seq", "d", "_e", F.explode(F.array(
        side("home", "away", "H", "gh", "ga"), side("away", "home", "A", "ga", "gh"))).alias("_s"))
    rows = rows.select("league", "block", "halo", "season", "match_seq", "d", "_e", "_s.*")
    by_venue = W.partitionBy("league", "block", "team", "venue").orderBy("match_seq")
    frame = by_venue.rangeBetween(-lookback, -1)
    e = F.col("_e")
    rows = rows.select(
        "*", F.coalesce(F.sum(e).over(frame), F.lit(0.0)).alias("w_venue"),
        F.sum(e * F.col("gf")).over(frame).alias("_sf"), F.sum(e * F.col("ga")).over(frame).alias("_sa"),
        F.collect_list(F.struct("match_seq", "gf", "ga")).over(by_venue.rowsBetween(1 - n_form, 0)).alias("_last"))
    by_team = W.partitionBy("league", "block", "team").orderBy("match_seq")
    before = by_team.rowsBetween(W.unboundedPreceding, -1)
    at_home = F.col("venue") == "H"
    rows = rows.select(
        "*", F.count(F.lit(1)).over(by_team.rangeBetween(-lookback, -1)).alias("n_prior"),
        F.last(F.when(at_home, F.col("_last")), ignorenulls=True).over(before).alias("_hl"),
        F.last(F.when(~at_home, F.col("_last")), ignorenulls=True).over(before).alias("_al"))
    empty = F.array().cast("array<struct<match_seq:bigint,gf:int,ga:int>>")
    rows = rows.where(~F.col("halo"))
    for c in ("_hl", "_al"):
        rows = rows.withColumn(c, F.filter(F.coalesce(F.col(c), empty), lambda x: x["match_seq"] >= F.col("match_seq") - F.lit(lookback)))
    own = F.when(at_home, F.col("_hl")).otherwise(F.col("_al"))
    rows = rows.select("*", F.coalesce(div("_sf", "w_venue"), F.lit(0.0)).alias("gf_venue"),
                       F.coalesce(div("_sa", "w_venue"), F.lit(0.0)).alias("ga_venue"),
                       *_form_columns(own, F.col("_hl"), F.col("_al")))
    return _rejoin(rows, ["league", "block", "match_seq"], kept).drop("block")


def _rejoin(rows: DataFrame, by: list[str], kept: Sequence[str]) -> DataFrame:
    """Put the two appearances of a match back on one row; grouped within the existing partitioning."""
    at_home = F.col("venue") == "H"

    def pick(here: Column, c: str) -> Column:
        return F.max(F.when(here, F.col(c)))

    return rows.groupBy(*by).agg(
        F.max("season").alias("season"), F.max("d").alias("d"),
        pick(at_home, "team").alias("home"), pick(~at_home, "team").alias("away"),
        pick(at_home, "gf").alias("gh"), pick(~at_home, "gf").alias("ga"),
        *[pick(at_home, c).alias(c) for c in kept],
        *[pick(at_home, c).alias(f"h_{c}") for c in TEAM_FIELDS],
        *[pick(~at_home, c).alias(f"a_{c}") for c in TEAM_FIELDS],
    )


def unbounded_state(matches: DataFrame, half_life: float | None = HALF_LIFE, n_form: int = 3, n_meet: int = 10,
                    block_rows: int = 1 << 16, carry: Sequence[str] = (),
                    order: str = "row", block_days: int = 28, first_season: int | None = None) -> DataFrame:
    """The same state over all earlier matches of the league (no frame).

    ``order="row"``: every earlier row counts, also of the same day. ``order="day"``: earlier days only.
    Adds ``run_home`` and ``run_away``, the plain goal means so far.

    What earlier blocks leave to a league, a pair or a team is computed from the matches, one row for
    each cell that has matches, and travels with the block's own rows: all windows share one shuffle
    by (league, block). The weights grow from the first date of a span of 450 half-lives; a block
    holds one span, and what earlier spans left is rescaled, so a half-life may be as short as you like.

    With ``first_season`` only matches of that season and later ones come back. All matches still count
    as history; blocks without a match that is asked for are no more than what they leave to later ones.
    """
    if order not in ("row", "day"):
        raise ValueError(f"unknown order {order!r}")
    base = matches.select("league", "season", "match_seq", "d", "home", "away", "gh", "ga", *carry)
    first, n_rows = base.agg(F.min("d"), F.count(F.lit(1))).first()
    at = F.col("match_seq") if order == "row" else F.unix_date("d")
    span, weight = spanned_growth(F.col("d"), F.lit(first).cast("date"), half_life)
    base = base.select("*", *pair_columns(), span.alias("_t"), weight.alias("_e"), at.cast("long").alias("_at"))
    # neither term decreases along a league, so a block is one run of positions within one span
    base = base.withColumn("_b", block_of("_at", block_rows if order == "row" else block_days) + F.col("_t"))
    own, e = F.col("_own"), F.col("_e")
    rows = base.withColumn("_own", F.lit(True))
    for left in (_league_carry(base), _pair_carry(base, n_meet), _team_carry(base, n_form)):
        rows = rows.unionByName(left.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    if first_season is not None:
        asked = base.where(F.col("season") >= first_season).groupBy(
            F.col("league").alias("_league"), F.col("_b").alias("_block")).agg(F.count(F.lit(1)).alias("_n")).persist()
        n_rows = asked.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        within = F.col("league").eqNullSafe(F.col("_league")) & F.col("_b").eqNullSafe(F.col("_block"))
        rows = rows.join(F.broadcast(asked.drop("_n")), within, "left_semi")
    rows = rows.repartition(tasks_for(n_rows, block_rows if order == "row" else 1), "league", "_b")

    def so_far(cell: list[str], sums: dict[str, Column]) -> list[Column]:
        """Sums over the earlier rows of the block and what the cell's row of carried sums holds."""
        whole = W.partitionBy("league", "_b", *cell)
        before = whole.orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
        return [(F.coalesce(F.sum(F.when(own, v)).over(before), F.lit(0))
                 + F.coalesce(F.max(f"_c{n}").over(whole), F.lit(0))).alias(n) for n, v in sums.items()]

    def last_of(carried: str, recent: Column, n: int) -> Column:
        none = F.filter(recent, lambda x: F.lit(False))
        empty = F.filter(F.col(carried), lambda x: F.lit(False))
        both = F.concat(F.coalesce(F.col(carried), none, F.array()), F.coalesce(recent, empty, F.array()))
        return F.slice(both, F.greatest(F.size(both) - F.lit(n - 1), F.lit(1)), n)

    m = rows.select("*", *so_far([], _league_sums()))
    pair = W.partitionBy("league", "_b", "_lo", "_hi")
    meeting = F.when(own, F.struct("home", "gh", "ga"))
    if order == "row":
        m = m.withColumn("_recent", F.collect_list(meeting).over(pair.orderBy("_at").rowsBetween(-n_meet, -1)))
    else:
        # the list left by the last row of the days before
        upto = F.collect_list(meeting).over(pair.orderBy("match_seq").rowsBetween(1 - n_meet, 0))
        m = m.withColumn("_upto", F.when(own, F.struct("match_seq", upto.alias("l"))))
        m = m.withColumn("_recent", F.max("_upto").over(pair.orderBy("_at").rangeBetween(W.unboundedPreceding, -1))["l"])
    m = m.withColumn("_cmet", F.max("_cmet").over(pair))
    m = m.withColumn("_met", last_of("_cmet", F.col("_recent"), n_meet))
    team_sums = [f"_c{n}" for n in _team_sums()]
    m = m.where(own | F.col("team").isNotNull()).select(
        "league", "_b", "_own", "_at", "season", "match_seq", "d", "home", "away", "gh", "ga", "_e", "team", *carry,
        *team_sums, "_chl", "_cal", F.col("match_seq").alias("n_league"),
        div("_fh", "_fw").alias("mean_home"), div("_fa", "_fw").alias("mean_away"),
        div("_sh", "_n").alias("run_home"), div("_sa", "_n").alias("run_away"), *_meetings(F.col("_met")))
    kept = [*carry, *LEAGUE_FIELDS, "run_home", "run_away", *MEETING_FIELDS]

    def side(team: str, venue: str | None, gf: str, ga: str) -> Column:
        fields = [F.col(c) if venue == "H" else F.lit(None).cast(m.schema[c].dataType) for c in kept]
        return F.struct(F.col(team).alias("_team"), F.lit(venue).cast("string").alias("venue"), F.col(gf).alias("gf"),
                        F.col(ga).alias("_against"), *[f.alias(f"_k_{c}") for f, c in zip(fields, kept)])

    sides = F.when(own, F.array(side("home", "H", "gh", "ga"), side("away", "A", "ga", "gh"))).otherwise(
        F.array(side("team", None, "gh", "ga")))
    t = m.select("league", "_b", "_own", "_at", "season", "match_seq", "d", "_e", *team_sums, "_chl", "_cal",
                 F.explode(sides).alias("_s"))
    t = t.select("league", "_b", "_own", "_at", "season", "match_seq", "d", "_e", *team_sums, "_chl", "_cal",
                 F.col("_s._team").alias("team"), "_s.venue", "_s.gf", F.col("_s._against").alias("ga"),
                 *[F.col(f"_s._k_{c}").alias(c) for c in kept])
    at_home = F.col("venue") == "H"
    by_venue = W.partitionBy("league", "_b", "team", "venue").orderBy("match_seq").rowsBetween(1 - n_form, 0)
    t = t.withColumn("_last", F.collect_list(F.when(own, F.struct("match_seq", "gf", "ga"))).over(by_venue))
    team = W.partitionBy("league", "_b", "team")
    before = team.orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    left = F.struct("match_seq", F.col("_last").alias("l"))
    latest = lambda here: F.max(F.when(own & here, left)).over(before)["l"]
    t = t.select("league", "_b", "_own", "season", "match_seq", "d", "team", "venue", "gf", "ga", *kept,
                 *so_far(["team"], _team_sums()), latest(at_home).alias("_rh"), latest(~at_home).alias("_ra"),
                 F.max("_chl").over(team).alias("_chl"), F.max("_cal").over(team).alias("_cal"))
    t = t.where(own if first_season is None else own & (F.col("season") >= first_season)).withColumns({"_hl": last_of("_chl", F.col("_rh"), n_form), "_al": last_of("_cal", F.col("_ra"), n_form)})
    venue = lambda p: F.when(at_home, F.col(f"{p}h")).otherwise(F.col(f"{p}a"))
    ratio = lambda p: F.coalesce(div(venue(p), venue("_w")), F.lit(0.0))
    t = t.select("league", "_b", "season", "match_seq", "d", "team", "venue", "gf", "ga", *kept, "n_prior",
                 ratio("_f").alias("gf_venue"), ratio("_g").alias("ga_venue"),
                 *_form_columns(F.when(at_home, F.col("_hl")).otherwise(F.col("_al")), F.col("_hl"), F.col("_al")))
    return _rejoin(t, ["league", "_b", "match_seq"], kept).drop("_b")


def _league_sums() -> dict[str, Column]:
    e, gh, ga = F.col("_e"), F.col("gh"), F.col("ga")
    return {"_fw": e, "_fh": e * gh, "_fa": e * ga, "_n": F.lit(1.0), "_sh": gh.cast("double"), "_sa": ga.cast("double")}


def _team_sums() -> dict[str, Column]:
    """Matches, and weights and weighted goals for and against at each venue."""
    e, at_home = F.col("_e"), F.col("venue") == "H"
    sums = {"n_prior": F.lit(1)}
    for v, here in (("h", at_home), ("a", ~at_home)):
        sums[f"_w{v}"] = F.when(here, e).otherwise(0.0)
        sums[f"_f{v}"] = F.when(here, e * F.col("gf")).otherwise(0.0)
        sums[f"_g{v}"] = F.when(here, e * F.col("ga")).otherwise(0.0)
    return sums


#: Sums that decay, by the sum of their weights; all others are plain.
LEAGUE_DECAYED = {"_fw": ["_fw", "_fh", "_fa"]}
TEAM_DECAYED = {f"_w{v}": [f"_w{v}", f"_f{v}", f"_g{v}"] for v in "ha"}


def _earlier_totals(cells: DataFrame, keys: list[str], names: Sequence[str], decayed: dict[str, list[str]]) -> DataFrame:
    """Add the sums of the earlier blocks of the keys (``_c``) to cells with a block's own (``_t``).

    Decayed sums are in the scale of the block's span. Of earlier spans only the last one with a
    weight counts, and the one right before that: anything older is below 2 ** -450 of it. If the
    block's own span has no weight yet, all sums of that last span shrink alike, never to zero.
    """
    blocks = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    in_span = W.partitionBy(*keys, "_t")
    spans = W.partitionBy(*keys).orderBy("_t")
    shrunk = lambda n: F.pow(F.lit(2.0), F.lit(-float(SPAN)) * n)

    def left(weight: str, of: list[str]) -> Column:
        sums = [(F.sum(f"_t{n}").over(in_span)
                 + F.coalesce(F.sum(f"_t{n}").over(spans.rangeBetween(-1, -1)), F.lit(0.0)) * shrunk(F.lit(1.0))).alias(n) for n in of]
        return F.when(F.sum(f"_t{weight}").over(in_span) > 0, F.struct("_t", *sums)).alias(f"_left{weight}")

    cells = cells.select("*", *[left(w, of) for w, of in decayed.items()])
    cells = cells.select("*", *[F.max(f"_left{w}").over(spans.rangeBetween(W.unboundedPreceding, -1)).alias(f"_last{w}") for w in decayed])
    held = {n: w for w, of in decayed.items() for n in of}

    def carried(n: str) -> Column:
        if n not in held:
            return F.coalesce(F.sum(f"_t{n}").over(blocks), F.lit(0))
        last = F.col(f"_last{held[n]}")
        own = F.sum(f"_t{n}").over(in_span.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        gap = F.least(F.col("_t") - last["_t"], F.lit(2)).cast("double")
        return F.coalesce(own, F.lit(0.0)) + F.coalesce(last[n] * shrunk(gap), F.lit(0.0))

    return cells.select("*", *[carried(n).alias(f"_c{n}") for n in names]).drop(*[f"_{p}{w}" for p in ("left", "last") for w in decayed])


def _league_carry(base: DataFrame) -> DataFrame:
    """Sums of a league's earlier blocks, one row per league and block."""
    sums = _league_sums()
    cells = base.groupBy("league", "_b").agg(F.max("_t").alias("_t"), *[F.sum(v).alias(f"_t{n}") for n, v in sums.items()])
    cells = _earlier_totals(cells, ["league"], list(sums), LEAGUE_DECAYED)
    return cells.select("league", "_b", *[f"_c{n}" for n in sums])


def _pair_carry(base: DataFrame, n: int) -> DataFrame:
    """The last ``n`` meetings in earlier blocks, one row per pair and block: a block passes on n rows at most.

    A pair's first block has none, and no row: with many teams most pairs meet once.
    """
    cell = ["league", "_lo", "_hi", "_b"]
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(F.desc("match_seq")))
    tails = base.withColumn("_k", rank).where(F.col("_k") <= n)
    along = W.partitionBy("league", "_lo", "_hi").orderBy("match_seq").rowsBetween(-n, -1)
    tails = tails.select(*cell, "match_seq", F.collect_list(F.struct("home", "gh", "ga")).over(along).alias("_cmet"))
    first = F.row_number().over(W.partitionBy(*cell).orderBy("match_seq"))
    return tails.withColumn("_k", first).where((F.col("_k") == 1) & (F.size("_cmet") > 0)).select(*cell, "_cmet")


def _team_carry(base: DataFrame, n: int) -> DataFrame:
    """A team's sums over earlier blocks and its last ``n`` rows at each venue, one row per team and block."""
    cell, sums, at_home = ["league", "team", "_b"], _team_sums(), F.col("venue") == "H"
    rows = appearances(base, ["_b", "_t", "_e"]).repartition(*cell)
    last = F.collect_list(F.struct("match_seq", "gf", "ga")).over(
        W.partitionBy(*cell, "venue").orderBy("match_seq").rowsBetween(1 - n, 0))
    rows = rows.withColumn("_l", F.struct("match_seq", last.alias("l")))
    cells = rows.groupBy(*cell).agg(
        F.max("_t").alias("_t"), *[F.sum(v).alias(f"_t{k}") for k, v in sums.items()],
        F.max(F.when(at_home, F.col("_l")))["l"].alias("_h"), F.max(F.when(~at_home, F.col("_l")))["l"].alias("_a"))
    cells = _earlier_totals(cells, ["league", "team"], list(sums), TEAM_DECAYED)
    cells = cells.select(*cell, "_h", "_a", *[f"_c{k}" for k in sums],
                         F.col("_h").isNotNull().alias("_has_h"), F.col("_a").isNotNull().alias("_has_a"))
    before = W.partitionBy("league", "team").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    for v in ("_h", "_a"):
        # a block with rows at the venue has one at least, so the last n such blocks hold the last n rows
        blocks = W.partitionBy("league", "team", f"_has{v}").orderBy("_b").rowsBetween(1 - n, 0)
        so_far = F.flatten(F.collect_list(v).over(blocks))
        cells = cells.withColumn(f"_left{v}", so_far)
        tail = F.slice(F.col(f"_left{v}"), F.greatest(F.size(f"_left{v}") - F.lit(n - 1), F.lit(1)), n)
        cells = cells.withColumn(f"_left{v}", F.when(F.col(f"_has{v}"), tail))
    return cells.select(*cell, *[f"_c{k}" for k in sums], F.last("_left_h", ignorenulls=True).over(before).alias("_chl"),
                        F.last("_left_a", ignorenulls=True).over(before).alias("_cal"))


def _last_by_venue(rows: DataFrame, n: int, payload: Column, day: str | None = None) -> DataFrame:
    """Last ``n`` home rows (``_hl``) and last ``n`` away rows (``_al``) of the team before each row.

    Each block leaves at most n rows per team and venue; a block starts from the last n of those. Fields
    of the payload that are named like a column must hold it.
    """
    cell = ["league", "team", "_b"]
    at_home = F.col("venue") == "H"
    starts = rows.select(*cell).distinct().select(*cell, F.explode(F.array(F.lit("H"), F.lit("A"))).alias("venue"))
    # dealt by cell, so that the lists of the venues, wider than their rows, pass through no shuffle
    rows, held = dealt_by_cell(rows, cell, payload, ["venue", "match_seq"])
    by_venue = W.partitionBy(*cell, "venue")
    last_n = F.collect_list("_p").over(by_venue.orderBy("match_seq").rowsBetween(1 - n, 0))
    tails = rows.withColumn("_k", F.row_number().over(by_venue.orderBy(F.desc("match_seq")))).where(F.col("_k") <= n)
    rows = rows.withColumn("_last", last_n)
    along = W.partitionBy("league", "team", "venue")
    tails = tails.select(*cell, "venue", "match_seq",
                         F.collect_list("_p").over(along.orderBy("match_seq").rowsBetween(1 - n, 0)).alias("_left"))
    order = along.orderBy("_b", F.col("match_seq").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        tails.unionByName(starts, allowMissingColumns=True)
        .withColumn("_left", F.last("_left", ignorenulls=True).over(order))
        .where(F.col("match_seq").isNull())
        .groupBy(*cell)
        .agg(F.max(F.when(at_home, F.col("_left"))).alias("_ch"), F.max(F.when(~at_home, F.col("_left"))).alias("_ca"))
    )
    before = earlier_rows(cell, ["match_seq"], day)
    # the list left by the latest earlier row of the venue
    left = F.struct("match_seq", F.col("_last").alias("l"))
    latest = lambda here: F.max(F.when(here, left)).over(before)["l"]
    rows = rows.select("*", latest(at_home).alias("_hl"), latest(~at_home).alias("_al"))
    rows = rows.join(carry, cell).withColumns({c: F.col("_p")[c] for c in held})
    none = F.filter(F.array("_p"), lambda x: F.lit(False))
    for have, c in (("_hl", "_ch"), ("_al", "_ca")):
        merged = F.concat(F.coalesce(F.col(c), none), F.coalesce(F.col(have), none))
        rows = rows.withColumn(have, F.slice(merged, F.greatest(F.size(merged) - F.lit(n - 1), F.lit(1)), n))
    return rows.drop("_p", "_last", "_ch", "_ca")
