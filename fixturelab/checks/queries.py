"""Registered queries: each operator and experiment over the contests view of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import blend as B
from ..functions import decay as D
from ..functions import odds as O
from ..functions import scores as S
from ..operators import blocks, features, state
from ..operators.asof import asof_backward
from ..plans import compare as C
from ..plans import feature_groups as FG
from ..plans import forecast as Y
from ..plans import learners as L
from ..plans import metrics as M
from ..plans import ratings as R
from ..plans import search as G
from ..plans import slips as P
from ..plans.components import FeatureConfig, component_state, components, components_of
from ..sources import contests as K
from ..sources import seasons as Q
from ..sources import store as H
from ..sources.store import stored

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Results in plain types: rounded doubles, dates as text, flags as 0/1.

    A billionth is added first, so that ties such as 2.0109375 fall alike in every engine.
    """
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind in ("double", "float"):
            c = F.round(c + F.lit(1e-9), digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("string")
        elif kind == "boolean":
            c = c.cast("int")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, "matches", {"sf": sf}, lambda: K.contests(spark, sf))


def last_season(spark: SparkSession, sf: str) -> int:
    """The latest season of the matches (-1 without any): tests and training windows hang on it."""
    row = matches(spark, sf).agg(F.max("season")).first()
    return -1 if row[0] is None else int(row[0])


def last_day(spark: SparkSession, sf: str) -> Column:
    """The date of the last match."""
    return F.lit(matches(spark, sf).agg(F.max("d")).first()[0]).cast("date")


def test_seasons(spark: SparkSession, sf: str) -> Column:
    """The last three seasons."""
    return F.col("season") >= last_season(spark, sf) - 2


def recent_seasons(spark: SparkSession, sf: str) -> list[int]:
    """The same seasons as numbers."""
    last = last_season(spark, sf)
    return [last - 2, last - 1, last]


FULL = FeatureConfig(lookback=None, min_history=0)
#: What a state depends on; all else of a configuration is made from its rows.
STATE = ("lookback", "half_life", "n_form", "n_meet", "min_history", "order")
PLAIN = FeatureConfig(lookback=None, min_history=0, league_means="plain")


def comps(spark: SparkSession, sf: str, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Components computed once per feature configuration and read by every experiment on them."""
    def build() -> DataFrame:
        m = matches(spark, sf)
        whole = config.lookback is None and config.order == "row" and config.block_rows is None
        return components(m, replace(config, block_rows=blocks.team_blocks(m, 4, 1 << 16)) if whole else config)

    return stored(spark, "components", {"sf": sf, **config.key()}, build)


def recent_comps(spark: SparkSession, sf: str, config: FeatureConfig = FULL) -> DataFrame:
    """Components of the last three seasons over all history. Configurations that differ in prices, margin
    method or league means alone share one state, which is stored for these seasons only."""
    m, shared = matches(spark, sf), replace(FULL, **{k: v for k, v in config.key().items() if k in STATE})

    def build() -> DataFrame:
        return component_state(m, replace(shared, block_rows=blocks.team_blocks(m, 4, 1 << 16)), recent_seasons(spark, sf))

    return components_of(stored(spark, "recent-state", {"sf": sf, "seasons": 3, **shared.key()}, build), m, config)


KEY = ["league", "season", "match_seq"]


# ---------------------------------------------------------------- matches, cleaning, checks

@query
def contests(spark, sf):
    """The numbered match table."""
    return out(matches(spark, sf))


@query
def market_by_league_season(spark, sf):
    """Proportional market probabilities scored by league and season."""
    m = matches(spark, sf).withColumn("actual", S.outcome("gh", "ga"))
    m = O.market_probabilities(m, K.OPENING, ["p1", "px", "p2"], "proportional")
    return out(M.metrics_rollup(M.scored(m, "first"), ["league", "season"]))


@query
def coverage_report(spark, sf):
    """How many matches carry a valid date and each kind of price."""
    n = lambda c: F.count(c).alias(f"n_{c}")
    return out(matches(spark, sf).groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), *[n(c) for c in ("d", "o1", "c1", "oover", "hst")]))


@query
def integrity_checks(spark, sf):
    """Duplicate matches, missing seasons and date order."""
    m = matches(spark, sf)
    dup = m.groupBy("league", "d", "home", "away", "gh", "ga").count().where("count > 1").groupBy("league").agg(
        F.count(F.lit(1)).alias("duplicate_keys"), F.max("count").alias("most_copies"))
    span = m.groupBy("league").agg(F.min("season").alias("_a"), F.max("season").alias("_b"))
    wanted = span.select("league", F.explode(F.sequence("_a", "_b")).alias("season"))
    gaps = wanted.join(m.select("league", "season").distinct(), ["league", "season"], "left_anti").groupBy("league").agg(
        F.count(F.lit(1)).alias("missing_seasons"))
    # positions are dense and blocks of them are compared with the last date of the block before
    b = m.select("league", "match_seq", "d", blocks.block_of("match_seq", 4096).alias("_b"))
    ordered = blocks.recent_rows(b, ["league"], "match_seq", "_b", 1, F.col("d"), "_prev")
    back = ordered.groupBy("league").agg(
        F.sum(F.when(F.size(F.filter("_prev", lambda x: x > F.col("d"))) > 0, 1).otherwise(0)).alias("date_steps_back"))
    r = span.select("league").join(dup, "league", "left").join(gaps, "league", "left").join(back, "league", "left")
    return out(r.na.fill(0))


@query
def teams_and_seasons(spark, sf):
    """Distinct teams on either side, and seasons."""
    m = matches(spark, sf)
    teams = m.select("league", F.col("home").alias("team")).union(m.select("league", "away")).distinct()
    t = teams.groupBy("league").agg(F.count(F.lit(1)).alias("teams"))
    return out(t.join(m.groupBy("league").agg(F.countDistinct("season").alias("seasons")), "league"))


@query
def season_split(spark, sf):
    """The last two seasons as test set, the earlier ones as training set."""
    m = matches(spark, sf)
    # one row per season
    ranked = m.select("season").distinct().withColumn("_k", F.dense_rank().over(W.orderBy(F.desc("season"))))
    test = F.broadcast(ranked.where(F.col("_k") <= 2).select("season"))
    a = m.join(test, "season", "left_semi").withColumn("part", F.lit("test"))
    b = m.join(test, "season", "left_anti").withColumn("part", F.lit("train"))
    return out(a.unionByName(b).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("season").alias("first_season"), F.max("season").alias("last_season"),
        F.avg("gh").alias("mean_home"), F.avg("ga").alias("mean_away"), (F.avg("gh") / F.avg("ga")).alias("home_advantage")))


def season_lines(spark, sf) -> DataFrame:
    """Contests printed as season files of three different layouts, with the usual defects."""
    m = matches(spark, sf)
    s, q = F.col("season") % 3, F.col("match_seq")
    two = F.date_format("d", "dd/MM/yy")
    date = F.when(q % 83 == 7, F.lit("n.d.")).when(s == 1, two).otherwise(F.date_format("d", "dd/MM/yyyy"))
    goal = F.when(q % 79 == 11, F.lit("x")).otherwise(F.col("gh").cast("string"))
    head = F.concat_ws(",", F.lit("I1"), date, F.concat(F.lit("T"), F.col("home").cast("string")),
                       F.concat(F.lit("T"), F.col("away").cast("string")), goal, F.col("ga").cast("string"))
    price = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    avg = [F.when(q % 5 == 0, F.lit("")).otherwise(price(c)) for c in K.OPENING]
    layout = (F.when(s == 0, F.concat_ws(",", head, *avg, *[price(c) for c in K.OPENING]))
              .when(s == 1, F.concat_ws(",", head, *[price(c) for c in K.OPENING]))
              .otherwise(F.concat_ws(",", head, *[price(c) for c in (*K.OPENING, *K.CLOSING, *K.TOTALS)])))
    line = (F.when(q % 97 == 5, F.concat(layout, F.lit(",1,2,3,4,5,6,7,8,9")))
            .when(q % 89 == 3, F.lit(",,,,,,,,")).when(q % 71 == 13, head).otherwise(layout))
    file = F.concat(F.lit("/L"), F.col("league").cast("string"), F.lit("/"), F.col("season").cast("string"), F.lit(".txt"))
    first = "Div,Date,{0},{1},FTHG,FTAG,"
    names = (F.when(s == 0, F.lit(first.format("HomeTeam", "AwayTeam") + "AvgH,AvgD,AvgA,B365H,B365D,B365A"))
             .when(s == 1, F.lit(first.format("Home", "Away") + "BbAvH,BbAvD,BbAvA"))
             .otherwise(F.lit(first.format("HomeTeam", "AwayTeam") + "B365H,B365D,B365A,AvgCH,AvgCD,AvgCA,Avg>2.5,Avg<2.5")))
    heads = m.select(file.alias("file"), F.lit(-1).cast("long").alias("line_no"), names.alias("line")).distinct()
    return m.select(file.alias("file"), q.alias("line_no"), line.alias("line")).unionByName(heads)


@query
def season_files(spark, sf):
    """Season files of changing layout read into one typed table."""
    t = Q.with_league(Q.with_season(Q.parse_lines(season_lines(spark, sf))))
    n = lambda c: F.count(c).alias(f"n_{c.lower()}")
    return out(t.groupBy("League", "Season").agg(
        F.count(F.lit(1)).alias("matches"), n("Date"), n("OddsAvgH"), n("OddsAvgCH"), n("OddsOver25"), n("B365H"),
        F.sum("FTHG").alias("home_goals"), F.sum("OddsAvgH").alias("sum_h"), F.sum("OddsAvgCA").alias("sum_ca"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date")).withColumnRenamed("League", "league").withColumnRenamed("Season", "season"))


@query
def season_files_by_row(spark, sf):
    """P1 row mode, P7, P11 from dates: first candidate with a value, dated rows only."""
    t = Q.with_season(Q.parse_lines(season_lines(spark, sf), mode="row", require_date=True), "date")
    return out(t.groupBy(F.col("Season").cast("int").alias("season")).agg(
        F.count(F.lit(1)).alias("matches"), F.count("OddsAvgH").alias("n_odds"), F.sum("OddsAvgH").alias("sum_h"), F.sum("FTAG").alias("away_goals")))


def season_files_on_disk(spark, sf) -> str:
    """Season files of all leagues in the shared folder: league 1 has some in Windows-1252, and league 0
    a file without team columns."""
    code = F.element_at(F.array(*[F.lit(c) for c in Q.LEAGUES]), F.regexp_extract("file", r"/L(\d+)/", 1).cast("int") + 1)
    name = F.element_at(F.split("file", "/"), -1)
    windows = (code == Q.LEAGUES[1]) & (F.regexp_extract("file", r"(\d+)\.txt$", 1).cast("int") % 3 == 2)
    text = F.regexp_replace("line", r"T(\d+)", F.when(windows, "T\u2019$1").otherwise("T\u00e9$1"))
    lines = season_lines(spark, sf).select(F.concat_ws("/", code, name).alias("file"), F.col("line_no").cast("long").alias("line_no"), text.alias("line"))
    first = matches(spark, sf).where(F.col("league") == 0)
    first = first.where(F.col("season") == first.agg(F.min("season")).first()[0])
    bare = first.select(F.lit(f"{Q.LEAGUES[0]}/notes.txt").alias("file"), "match_seq", F.concat_ws(",", F.lit("I1"), "gh", "ga").alias("line"))
    head = first.limit(1).select(F.lit(f"{Q.LEAGUES[0]}/notes.txt").alias("file"), F.lit(-1).cast("long").alias("match_seq"), F.lit("Div,FTHG,FTAG").alias("line"))
    return H.stored_files(spark, "season-files", {"sf": sf}, lambda path: Q.write_files(lines.union(bare).union(head), path))


@query
def season_folder(spark, sf):
    """Season files of all leagues read from their folders, each in its own encoding."""
    t = Q.load_seasons(spark, f"{season_files_on_disk(spark, sf)}/*")
    return out(t.groupBy(F.col("League").alias("league"), F.col("Season").alias("season")).agg(
        F.count(F.lit(1)).alias("matches"), F.count("Date").alias("n_date"), F.count("OddsAvgH").alias("n_oddsavgh"),
        F.sum("FTHG").cast("long").alias("home_goals"), F.sum("OddsAvgH").alias("sum_h"),
        F.count_if(F.contains("HomeTeam", F.lit("\u2019")) & F.contains("AwayTeam", F.lit("\u2019"))).alias("n_quote"),
        F.count_if(F.contains("HomeTeam", F.lit("\u00e9")) & F.contains("AwayTeam", F.lit("\u00e9"))).alias("n_accent"), F.min("Date").alias("first_date")))


@query
def league_files(spark, sf):
    """One league by its code, dated rows only, seasons from the dates."""
    t = Q.load_league(spark, season_files_on_disk(spark, sf), Q.LEAGUES[1])
    return out(Q.coverage(t, [F.col("Season").cast("int").alias("season")]))


@query
def rejected_season_lines(spark, sf):
    """Lines of the files that are no matches, by reason."""
    r = Q.rejected_lines(Q.read_files(spark, f"{season_files_on_disk(spark, sf)}/*"))
    return out(r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")))


@query
def match_store(spark, sf):
    """Matches stored by league and season; the last seasons are written anew and read alone."""
    m, recent = matches(spark, sf), last_season(spark, sf) - 2

    def write(path: str) -> None:
        H.write_matches(m.withColumn("gh", F.when(F.col("season") < recent, F.col("gh")).otherwise(F.lit(99))), path)
        H.write_matches(m.where(F.col("season") >= recent), path)

    path = H.stored_files(spark, "match-store", {"sf": sf}, write)
    return out(H.read_matches(spark, path, recent).groupBy(F.col("league").cast("long").alias("league"), "season").agg(
        F.count(F.lit(1)).alias("matches"), F.sum("gh").alias("home_goals"), F.sum("ga").alias("away_goals"), F.sum("o1").alias("sum_o1")))


# ---------------------------------------------------------------- odds

@query
def odds_cascade(spark, sf):
    """Price groups per row, price by price fallback, margins."""
    m = matches(spark, sf)
    m = m.select(*KEY, *O.pick_source([K.CLOSING, K.OPENING], ["s1", "sx", "s2"], None, "source", ["closing", "opening"]),
                 *O.first_known(K.CLOSING, K.OPENING, ["f1", "fx", "f2"]), "oover", "ounder")
    return out(m.select("*", O.margin(["s1", "sx", "s2"]).alias("margin"),
                        O.all_known(["oover", "ounder"], above=1.0).alias("has_ou")).drop("fx", "f2"))


@query
def shin_probabilities(spark, sf):
    """margin-free probabilities of three-way and two-way prices."""
    m = O.shin(matches(spark, sf).select(*KEY, *K.OPENING, *K.CLOSING, *K.TOTALS), K.OPENING, ["p1", "px", "p2"])
    m = O.shin(m, K.CLOSING, ["k1", "kx", "k2"])
    m = O.shin(m, K.TOTALS, ["p_over", "p_under"])
    return out(m.drop(*K.OPENING, *K.CLOSING, *K.TOTALS))


@query
def match_analysis(spark, sf):
    """F16: pick, confidence, picked price and margin of each match."""
    m = O.analyse_1x2(matches(spark, sf).select(*KEY, *K.OPENING), K.OPENING)
    return out(m.drop(*K.OPENING))


@query
def over_under_analysis(spark, sf):
    """totals pick from the market and blended with a model probability."""
    m = matches(spark, sf).select(*KEY, *K.TOTALS, ((F.col("match_seq") % 10).cast("double") / 10.0).alias("model"))
    a = O.analyse_over_under(m, "oover", "ounder")
    found = [c for c in a.columns if c not in m.columns]
    a = a.withColumnsRenamed({c: f"_own_{c}" for c in found})
    b = O.analyse_over_under(a, "oover", "ounder", "model", 0.5).withColumnsRenamed({"ou_pick": "blend_pick", "ou_confidence": "blend_confidence"})
    return out(b.select(*KEY, *[F.col(f"_own_{c}").alias(c) for c in found if c != "ou_valid"], "blend_pick", "blend_confidence"))


@query
def meeting_prices(spark, sf):
    """Market probabilities from the prices of past meetings."""
    return out(features.meeting_prices(matches(spark, sf)))


# ---------------------------------------------------------------- decay and strengths

@query
def decayed_means(spark, sf):
    """A1 A2: goals per home team and half-life, decayed towards a day 127 days before the last match."""
    m = matches(spark, sf)
    ref = F.date_sub(last_day(spark, sf), 127)
    parts = [D.decayed_group_mean(m, ["league", "home"], "gh", "d", ref, h, "mean").withColumn("half_life", F.lit(n))
             for h, n in ((730.0, "730"), (90.0, "90"), (None, "none"))]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def league_means_fixed(spark, sf):
    """A3 A5: decayed and plain league means at the last date."""
    m = matches(spark, sf)
    last = last_day(spark, sf)
    a = D.league_means(m, last, 730.0)
    b = m.groupBy("league").agg(F.avg("gh").alias("plain_home"), F.avg("ga").alias("plain_away"), (F.avg("gh") / F.avg("ga")).alias("home_advantage"))
    return out(a.join(b, "league"))


@query
def team_strengths(spark, sf):
    """Decayed attack and defence of every team at home and away."""
    return out(D.team_strengths(state.appearances(matches(spark, sf)), last_day(spark, sf), 730.0))


@query
def walk_forward_state(spark, sf):
    """State of both teams over the last 1600 league matches."""
    return out(state.bounded_state(matches(spark, sf)).drop("gh", "ga"))


@query
def unbounded_state(spark, sf):
    """The same over all earlier matches."""
    m = matches(spark, sf)
    return out(state.unbounded_state(m, block_rows=blocks.team_blocks(m, 4)).drop("gh", "ga"))


# ---------------------------------------------------------------- optional features

@query
def form_rest_venue(spark, sf):
    """Last three matches with letters, rest days, last venue."""
    m = matches(spark, sf)
    return out(features.recent_form(m, block_rows=blocks.team_blocks(m, 64)))


@query
def congestion(spark, sf):
    """Matches in the fourteen days before."""
    return out(features.congestion(matches(spark, sf)))


@query
def recent_statistics(spark, sf):
    """Recent shots on target and corners, for and against."""
    pairs = {"shots_for": ("hst", "ast"), "shots_against": ("ast", "hst"), "corners_for": ("hc", "ac"), "corners_against": ("ac", "hc")}
    m = matches(spark, sf)
    return out(features.recent_mean(m, pairs, block_rows=blocks.team_blocks(m, 64)))


@query
def progressive_standings(spark, sf):
    """Points and matches played before each match."""
    m = matches(spark, sf)
    return out(features.standings(m, block_rows=blocks.team_blocks(m, 64)).select(*KEY, "team", "venue", "points", "played"))


@query
def table_thresholds(spark, sf):
    """Points ahead of the 17th and the 6th of the table."""
    m = matches(spark, sf)
    return out(features.thresholds(m, block_rows=blocks.team_blocks(m, 4)))


# ---------------------------------------------------------------- lookups

def rating_history(spark, sf) -> DataFrame:
    """Ratings from each quarter's goal difference, valid in the next quarter (some end early)."""
    app = state.appearances(matches(spark, sf))
    r = app.groupBy("team", F.trunc("d", "quarter").alias("_q")).agg((F.lit(1500.0) + F.lit(100.0) * F.avg(F.col("gf") - F.col("ga"))).alias("elo"))
    start = F.add_months("_q", 3)
    end = F.when(F.col("team") % 7 == 0, F.date_add(start, 45)).otherwise(F.date_sub(F.add_months("_q", 6), 1))
    return r.select("team", "elo", start.alias("valid_from"), end.alias("valid_to"))


def rated_matches(spark, sf) -> DataFrame:
    return stored(spark, "rated", {"sf": sf}, lambda: R.with_ratings(matches(spark, sf).select(*K.CORE), rating_history(spark, sf)))


@query
def asof_ratings(spark, sf):
    """Rating of both teams valid on the day of the match."""
    return out(R.with_ratings(matches(spark, sf).select(*K.CORE), rating_history(spark, sf)).drop("gh", "ga"))


@query
def rating_file(spark, sf):
    """Ratings written as a file of periods and read again."""
    history = rating_history(spark, sf)
    path = H.stored_files(spark, "ratings", {"sf": sf}, lambda to: Q.write_ratings(history, to))
    r = Q.read_ratings(spark, path)
    return out(r.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.avg("elo").alias("elo"), F.min("valid_from").alias("first_day"), F.max("valid_to").alias("last_day")))


@query
def asof_events(spark, sf):
    """J1 on event times: last purchase of the user within its three days of validity."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    left = e.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == "purchase").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    right = right.withColumn("until", F.col("ts") + F.expr("interval 3 days")).withColumnRenamed("ts", "since")
    return out(asof_backward(left, right, ["user_id"], "ts", "since", ["value"], "until").drop("ts"))


@query
def missing_ratings(spark, sf):
    """Without a rating table the feature is off, not an error."""
    r = R.with_ratings(matches(spark, sf).select(*K.CORE), None)
    r = R.rating_goals(r, (0.1, 0.001), (0.0, -0.001))
    return out(r.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.count("elo_home").alias("rated"), F.avg("xh_elo").alias("xh_elo"), F.avg("xa_elo").alias("xa_elo")))


def external_goals(spark, sf) -> DataFrame:
    app = state.appearances(matches(spark, sf))
    e = app.where(~((F.col("team") % 11 == 3) & (F.col("venue") == "A"))).groupBy("team", "d", "venue").agg(
        (F.lit(0.3) + F.lit(0.8) * F.avg("gf")).alias("xg"))
    club = F.when(F.col("team") == 0, F.lit("FC Zero")).otherwise(F.concat(F.lit("T"), F.col("team").cast("string")))
    return e.select(club.alias("club"), "d", F.when(F.col("venue") == "H", F.lit("h")).otherwise(F.lit("a")).alias("home_away"), "xg")


@query
def external_goal_file(spark, sf):
    """External goals of one league read from a file."""
    app = state.appearances(matches(spark, sf))
    e = app.where(~((F.col("team") % 11 == 3) & (F.col("venue") == "A"))).groupBy("league", "team", "d", "venue").agg(
        (F.lit(0.3) + F.lit(0.8) * F.avg("gf")).alias("xG"))
    club = F.when(F.col("team") == 0, F.lit("FC Zero")).otherwise(F.concat(F.lit("T"), F.col("team").cast("string")))
    rows = e.select(F.col("d").cast("timestamp").alias("date"), F.concat(F.lit("L"), F.col("league").cast("string")).alias("league"), club.alias("club_name"),
                    F.when(F.col("venue") == "H", F.lit("h")).otherwise(F.lit("a")).alias("home_away"), "xG")
    path = H.stored_files(spark, "external-goals", {"sf": sf}, lambda to: H.write_results(rows, to, "csv"))
    x = Q.read_external_goals(spark, path, "L0")
    return out(x.groupBy("club").agg(F.count("d").alias("n"), F.count_if(F.col("home_away") == "h").alias("at_home"), F.sum("xg").alias("xg")))


@query
def external_goal_lookup(spark, sf):
    """External goals joined by team, date and venue after renaming."""
    m = matches(spark, sf).select(*KEY, "d", F.concat(F.lit("T"), F.col("home").cast("string")).alias("home"), F.concat(F.lit("T"), F.col("away").cast("string")).alias("away"))
    j = Q.join_external_goals(m, external_goals(spark, sf), {"FC Zero": "T0"})
    return out(j)


@query
def rating_regression(spark, sf):
    """Goals regressed on the rating difference."""
    rated = rated_matches(spark, sf)
    fits = {g: R.fit_rating_goals(rated, g) for g in ("gh", "ga")}
    r = R.rating_goals(rated, fits["gh"], fits["ga"])
    return out(r.groupBy("league").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("elo_valid").cast("long")).alias("rated"),
        F.avg("xh_elo").alias("xh_elo"), F.avg("xa_elo").alias("xa_elo"), F.max("xh_elo").alias("max_xh_elo")), 4)


# ---------------------------------------------------------------- components, scores, blends

@query
def match_components(spark, sf):
    """Walk-forward components of all leagues."""
    return out(comps(spark, sf))


@query
def match_components_full(spark, sf):
    """Components over all history with plain league means and opening prices."""
    cfg = FeatureConfig(lookback=None, min_history=0, league_means="plain", odds_source="opening", odds_method="proportional")
    return out(comps(spark, sf, cfg))


@query
def score_outcomes(spark, sf):
    """Outcome and over/under probabilities of the corrected score grid."""
    c = comps(spark, sf).select(*KEY, "xh_hist", "xa_hist")
    return out(S.score_outcomes(c, "xh_hist", "xa_hist", -0.30).drop("xh_hist", "xa_hist"))


@query
def top_scores(spark, sf):
    """The five likeliest exact scores."""
    c = comps(spark, sf).select(*KEY, *[F.greatest(F.round(F.col(x) + F.lit(1e-9), 3), F.lit(0.05)).alias(n) for x, n in (("xh_hist", "l"), ("xa_hist", "m"))])
    # rates have three digits, so matches of equal rates share one grid
    t = S.top_scores(c.groupBy("l", "m").agg(F.count(F.lit(1)).alias("_n")), "l", "m", -0.10)
    t = t.select("_n", F.posexplode("top_scores").alias("place", "_s")).select("_n", "place", F.col("_s.score").alias("score"), F.col("_s.p").alias("p"))
    known = F.when(F.col("p").isNotNull(), F.col("_n"))
    return out(t.groupBy("place", "score").agg(
        F.sum("_n").alias("n"), O.div(F.sum(F.col("p") * F.col("_n")), F.sum(known)).alias("p")))


@query
def blended_probabilities(spark, sf):
    """production blend and an overfull weight set on every match."""
    c = comps(spark, sf)
    a = B.blend_1x2(c, 0.10, 0.0, 0.90).withColumnsRenamed({n: f"_a_{n}" for n in ("p1", "px", "p2", "xh", "xa")})
    b = B.blend_1x2(a, 0.50, 0.40, 0.60, rho=-0.2)
    return out(b.select(*KEY, *[F.col(f"_a_{n}").alias(n) for n in ("p1", "px", "p2", "xh", "xa")],
                        *[F.col(n).alias(f"b{n[1]}") for n in ("p1", "px", "p2")]))


@query
def over_blend(spark, sf):
    """Over 2.5 from model, blend and market."""
    c = comps(spark, sf)
    c = B.blend_over(c, 0.10, 0.0, 0.0, out="p_model")
    c = B.blend_over(c, 0.15, 0.2, 0.5, out="p_blend")
    return out(c.select(*KEY, "p_model", "p_blend", F.col("q_over").alias("p_market"), "over_actual"))


@query
def learner_features(spark, sf):
    """Feature table with values masked where they are not valid."""
    return out(L.feature_table(comps(spark, sf)).drop("elo_home", "elo_away", "elo_diff"))


GROUPS = ("ratings", "shots", "rest", "motivation")


@query
def learner_feature_groups(spark, sf):
    """Feature table with every group switched on."""
    m = matches(spark, sf)
    f = FG.grouped_features(comps(spark, sf), m, GROUPS, rated_matches(spark, sf), block_rows=blocks.team_blocks(m, 16))
    return out(f.select(*KEY, *[c for c in f.columns if c not in (*KEY, "actual")]))


def production(c: DataFrame) -> DataFrame:
    return B.blend_1x2(c, 0.10, 0.0, 0.90)


# ---------------------------------------------------------------- backtest metrics

@query
def backtest_metrics(spark, sf):
    """Backtest by season and in total."""
    s = M.scored(production(comps(spark, sf)))
    return out(M.metrics_rollup(s, ["season"]))


@query
def backtest_by_league(spark, sf):
    """The same by league and season."""
    return out(M.metrics(M.scored(production(comps(spark, sf))), ["league", "season"]))


@query
def confusion_matrix(spark, sf):
    """Actual against predicted."""
    return out(M.confusion(M.scored(production(comps(spark, sf)))))


@query
def class_report(spark, sf):
    """Precision, recall, F1 and support."""
    return out(M.class_report(M.scored(production(comps(spark, sf)))))


@query
def result_file(spark, sf):
    """Results written as a file and read again."""
    found = M.class_report(M.scored(production(comps(spark, sf))))
    path = H.stored_files(spark, "class-report", {"sf": sf}, lambda to: H.write_results(found, to, "csv"))
    return out(spark.read.option("header", True).schema(found.schema).csv(path))


@query
def confidence_calibration(spark, sf):
    """Declared against observed rates by confidence bin."""
    s = M.scored(production(comps(spark, sf)), "first").withColumn("conf", F.greatest("p1", "px", "p2"))
    return out(M.calibration(s, ["league"], "conf", F.col("hit")))


# ---------------------------------------------------------------- configurations

# Weights of form, meetings, odds and ratings.
CONFIGS = [
    (0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.0), (0.5, 0.15, 0.15, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.15, 0.85, 0.0),
    (0.10, 0.0, 0.90, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.9, 0.1),
]


@query
def configuration_table(spark, sf):
    """Eight weightings side by side, with ratings."""
    rated = rated_matches(spark, sf)
    train = rated.where(~test_seasons(spark, sf))
    r = R.rating_goals(rated, R.fit_rating_goals(train, "gh"), R.fit_rating_goals(train, "ga"))
    c = recent_comps(spark, sf)
    c = c.join(r.select("league", "match_seq", "elo_valid", "xh_elo", "xa_elo"), ["league", "match_seq"])
    c = G.with_configs(c, CONFIGS, ["form", "meet", "odds", "elo"])
    s = M.scored(B.blend_1x2(c, "form", "meet", "odds", elo="elo"))
    return out(s.groupBy("form", "meet", "odds", "elo").agg(F.count(F.lit(1)).alias("n"), M.rate(F.col("hit")).alias("accuracy"), F.avg("rps").alias("rps")), 4)


def _macro(spark, sf, variants: dict[str, FeatureConfig], blends: dict[str, tuple[float, float, float]]) -> DataFrame:
    parts = None
    for name, cfg in variants.items():
        c = recent_comps(spark, sf, cfg)
        for label, (form, meet, odds) in blends.items():
            s = M.scored(B.blend_1x2(c, form, meet, odds)).withColumn("variant", F.lit(name)).withColumn("blend", F.lit(label))
            s = s.select("variant", "blend", "season", "hit", "actual", "pred", "rps", "logloss")
            parts = s if parts is None else parts.unionByName(s)
    return M.macro_mean(parts, ["variant", "blend"])


PROD = {"production": (0.10, 0.0, 0.90)}


@query
def shin_vs_proportional(spark, sf):
    """Margin methods, mean over three test seasons."""
    return out(_macro(spark, sf, {"shin": FULL, "proportional": replace(FULL, odds_method="proportional")}, PROD))


@query
def closing_vs_opening(spark, sf):
    """Price sources, mean over three test seasons."""
    return out(_macro(spark, sf, {"closing": FULL, "opening": replace(FULL, odds_source="opening")}, PROD))


@query
def league_mean_modes(spark, sf):
    """Decayed against plain league means, in production and without odds."""
    return out(_macro(spark, sf, {"weighted": FULL, "plain": PLAIN}, {**PROD, "model": (0.10, 0.0, 0.0)}))


@query
def blend_weight_grid(spark, sf):
    """Accuracy and RPS of every form x odds weight, mean over three seasons."""
    c = recent_comps(spark, sf)
    c = G.with_configs(c, G.blend_configs(), ["form", "odds"])
    s = M.scored(B.blend_1x2(c, "form", 0.0, "odds"))
    return out(M.macro_mean(s, ["form", "odds"]))


# ---------------------------------------------------------------- comparisons

def _sides(a: tuple, b: tuple) -> list[Column]:
    """Two triples of one row as forecasts a and b."""
    return [F.col(c).alias(f"{n}_{side}") for side, triple in (("a", a), ("b", b)) for c, n in zip(triple, ("p1", "px", "p2"))]


def _model_vs_market(spark, sf) -> DataFrame:
    c = comps(spark, sf).where(F.col("has_odds"))
    # both forecasts come from the same row
    return C.pair_1x2(production(c).select(*KEY, "actual", *_sides(("p1", "px", "p2"), ("q1", "qx", "q2"))))


def _cell() -> Column:
    return F.col("match_seq") * F.lit(5) + F.col("league")


@query
def paired_scores(spark, sf):
    """Both forecasts of each match and the discordant counts by league."""
    return out(C.pair_counts(_model_vs_market(spark, sf), ["league"]))


@query
def model_vs_market(spark, sf):
    """Model against market, per league and pooled."""
    return out(C.report(C.scopes(_model_vs_market(spark, sf)), ["scope"], _cell()))


@query
def over_under_vs_market(spark, sf):
    """Totals model against the totals market, per league and pooled."""
    c = comps(spark, sf).where(F.col("has_ou"))
    c = B.blend_over(c, 0.10, 0.0, 0.0, out="p_a").withColumn("p_b", F.col("q_over"))
    return out(C.report(C.scopes(C.pair_binary(c)), ["scope"], _cell()))


@query
def over_under_blend_sweep(spark, sf):
    """Totals blends from pure model to pure market."""
    c = comps(spark, sf).where(F.col("has_ou"))
    c = G.with_configs(c, [(w,) for w in (0.0, 0.25, 0.50, 0.75, 0.90, 1.0)], ["weight"])
    c = B.blend_over(c, 0.10, 0.0, "weight", out="p_a").withColumn("p_b", F.col("q_over"))
    return out(C.report(C.pair_binary(c), ["weight"], _cell()))


@query
def configuration_differences(spark, sf):
    """Closing against opening, decayed against plain means, model against market."""
    f = lambda cfg, w=(0.10, 0.0, 0.90): B.blend_1x2(recent_comps(spark, sf, cfg), *w).select(*KEY, "actual", "p1", "px", "p2")
    named = {"base": f(FULL), "opening": f(replace(FULL, odds_source="opening")), "plain": f(PLAIN), "market": f(FULL, (0.0, 0.0, 1.0))}
    rows = C.lined_up(named, KEY)
    triple = lambda n: tuple(f"{p}_{n}" for p in ("p1", "px", "p2"))
    scopes = {"closing vs opening": "opening", "decayed vs plain means": "plain", "model vs market": "market"}
    pair = lambda label, other: F.struct(F.lit(label).alias("scope"), *_sides(triple("base"), triple(other)))
    pairs = rows.select(*KEY, "actual", F.explode(F.array(*[pair(*x) for x in scopes.items()])).alias("_p")).select(*KEY, "actual", "_p.*")
    parts = C.pair_1x2(pairs).select("scope", *KEY, "ok_a", "ok_b", "score_a", "score_b")
    return out(C.report(parts, ["scope"], _cell()))


@query
def power_needed(spark, sf):
    """M8 M9: matches needed to settle each comparison of form weights."""
    c = comps(spark, sf).where(F.col("has_odds"))
    c = G.with_configs(c, [(w,) for w in (0.02, 0.05, 0.10, 0.15, 0.20)], ["weight"])
    one = F.lit(1.0) - F.col("weight")
    model = B.blend_1x2(c, "weight", 0.0, one).select("weight", *KEY, "actual", F.col("p1").alias("p1_a"), F.col("px").alias("px_a"), F.col("p2").alias("p2_a"),
                                                      F.col("q1").alias("p1_b"), F.col("qx").alias("px_b"), F.col("q2").alias("p2_b"))
    # one row per weight and league: a few counts
    r = C.report(C.pair_1x2(model), ["weight", "league"], _cell())
    r = r.withColumn("needed_score", C.needed_for_score(F.col("ci_low"), F.col("ci_high"), F.col("diff"), F.col("n")))
    r = C.needed_for_accuracy(r, ["weight", "league"])
    return out(r.select("weight", "league", "n", "only_a", "only_b", F.coalesce("needed_score", F.lit(-1)).alias("needed_score"),
                        F.coalesce("needed_accuracy", F.lit(-1)).alias("needed_accuracy")))


# ---------------------------------------------------------------- search

def search_results(spark, sf) -> DataFrame:
    return stored(spark, "search", {"sf": sf}, lambda: G.search(comps(spark, sf)))


@query
def configuration_search(spark, sf):
    """2,115 combinations of model, markets and threshold."""
    return out(search_results(spark, sf))


@query
def search_marginals(spark, sf):
    """Mean effect of each value of each parameter."""
    return out(G.marginal_effects(search_results(spark, sf)))


@query
def search_best(spark, sf):
    """Ten best by hit rate among those selecting a quarter of the matches."""
    return out(G.best(search_results(spark, sf).withColumn("hit_rate", F.round("hit_rate", 9)), "hit_rate", min_share=0.25).drop("p_slip_13"))


# ---------------------------------------------------------------- slips

def raw_fixtures(spark, sf) -> DataFrame:
    """Fixture rows as a user might type them: gaps, equal teams, low or missing prices."""
    q = F.col("match_seq")
    void = q % 61 == 0
    cell = lambda c, bad=F.lit(False): F.when(~(void | bad), F.col(c)).alias(c)
    return matches(spark, sf).select(
        *KEY, "d", cell("home", q % 53 == 1), F.when(~void, F.when(q % 47 == 2, F.col("home")).otherwise(F.col("away"))).alias("away"),
        cell("o1", q % 43 == 3), F.when(~void, F.when(q % 41 == 4, F.lit(0.95)).otherwise(F.col("ox"))).alias("ox"), cell("o2"), cell("oover"), cell("ounder"))


@query
def fixture_validation(spark, sf):
    """Reasons why typed fixtures are rejected."""
    v = P.validate(raw_fixtures(spark, sf))
    return out(v.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("match_seq").alias("sum_seq")))


def weekly(df: DataFrame) -> DataFrame:
    return df.withColumn("week", F.date_trunc("week", "d").cast("date"))


def weekly_picks(spark, sf, markets: str = "both") -> DataFrame:
    """Production picks of every match; the leagues share the slips of a week. Odds and probabilities
    come from the same prices, closing first."""
    c = comps(spark, sf).where(F.col("has_odds") & F.col("has_ou"))
    prices = O.pick_source([K.CLOSING, K.OPENING], K.OPENING)
    c = c.join(matches(spark, sf).select("league", "match_seq", *prices, *K.TOTALS), ["league", "match_seq"])
    c = c.select("*", F.col("q1").alias("p1"), F.col("qx").alias("px"), F.col("q2").alias("p2"), F.col("q_over").alias("p_over"))
    p = P.market_candidates(weekly(c), markets=markets)
    return p.withColumn("hit", P.hit_of(p))


@query
def slip_picks(spark, sf):
    """K4: best market of each match."""
    return out(weekly_picks(spark, sf).select(*KEY, "market", "pick", "confidence", "pick_odds", "margin", "hit"))


@query
def slip_selection(spark, sf):
    """K2 K3 U4: picks above the threshold, thirteen per slip, and the excluded ones."""
    p = weekly_picks(spark, sf).select("league", "match_seq", "week", F.round("confidence", 9).alias("confidence"))
    s = P.select_top(p, ["week"], 13, 0.55)
    return out(s.groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("selected").cast("long")).alias("selected"),
                                     F.min(F.when(F.col("selected"), F.col("confidence"))).alias("lowest"),
                                     F.sum(F.when(F.col("selected"), F.col("match_seq"))).cast("double").alias("sum_seq")))


def week_slips(spark, sf, size: int = 13) -> DataFrame:
    p = weekly_picks(spark, sf).withColumn("confidence", F.round("confidence", 9))
    return P.best_of(p, ["week"], size)


@query
def slip_summary(spark, sf):
    """Multiplier, exact hit distribution and expected return per slip."""
    s = P.summarise(week_slips(spark, sf), ["week"])
    s = s.withColumn("expected_hits", P.expected_hits())
    # a price product of thirteen picks is large: its logarithm is compared
    s = s.withColumn("multiplier", F.log("multiplier")).withColumn("one_in", F.log("one_in"))
    return out(s.drop("distribution"))


@query
def slip_hits_tail(spark, sf):
    """The four highest numbers of hits per slip."""
    return out(P.top_tail(P.summarise(week_slips(spark, sf), ["week"]), ["week"]))


@query
def weekly_slip_backtest(spark, sf):
    """Full slips declared and observed, by market mode."""
    parts = None
    for markets in ("both", "1X2", "Over/Under"):
        p = weekly_picks(spark, sf, markets).withColumn("confidence", F.round("confidence", 9))
        b = P.slip_backtest(p, ["week"]).agg(
            F.count(F.lit(1)).alias("slips"), F.sum("full").alias("full"), F.avg("full").alias("observed"),
            F.avg("declared").alias("declared"), F.avg("hits").alias("mean_hits")).withColumn("markets", F.lit(markets))
        parts = b if parts is None else parts.unionByName(b)
    return out(parts)


@query
def latest_round(spark, sf):
    """The last twenty matches with all prices known."""
    m = matches(spark, sf).where(O.all_known([*K.CLOSING, *K.TOTALS], above=1.0))
    return out(m.orderBy(F.desc("d"), F.desc("match_seq"), "league").limit(20).select(*KEY, "d", "home", "away", "c1", "oover"))


# ---------------------------------------------------------------- forecasts of fixtures

def fixtures_of(spark, sf) -> DataFrame:
    """Pairings of the last season; a third of them comes without prices."""
    m = matches(spark, sf).where(F.col("season") == last_season(spark, sf))
    price = lambda c: F.max_by(c, "match_seq").alias(c)
    f = m.groupBy("league", "home", "away").agg(F.max("match_seq").alias("match_seq"), *[price(c) for c in (*K.OPENING, *K.TOTALS)])
    return f.select("league", "home", "away", "match_seq", *[F.when(F.col("match_seq") % 3 != 0, F.col(c)).alias(c) for c in (*K.OPENING, *K.TOTALS)])


@query
def fixture_forecasts(spark, sf):
    """Full forecast of every pairing of the last season from the seasons before."""
    history = matches(spark, sf).where(F.col("season") < last_season(spark, sf))
    f = Y.forecast(history, fixtures_of(spark, sf).select("league", "home", "away", *K.OPENING), 0.3, 0.2, 0.4)
    return out(f.drop(*K.OPENING, "q1", "qx", "q2").withColumn("top_scores", F.concat_ws(" ", F.transform("top_scores", lambda x: x["score"]))).drop("top_scores"))


@query
def slip_builder(spark, sf):
    """Validated fixtures, forecast, best market, thirteen per slip, summary."""
    history = matches(spark, sf).where(F.col("season") < last_season(spark, sf))
    _, s = Y.build_slips(history, fixtures_of(spark, sf), ["league"], ["match_seq"])
    s = s.withColumn("multiplier", F.log("multiplier")).withColumn("one_in", F.log("one_in"))
    return out(s.drop("distribution"))


# ---------------------------------------------------------------- rating and learned models

#: Matches of a league between two refits of the pooled model.
REFIT_EVERY = 10


def pooled_params(spark, sf) -> DataFrame:
    """Refits for the matches of the last three seasons."""
    config = {"sf": sf, "every": REFIT_EVERY, "seasons": 3, "shrinkage": R.SHRINKAGE}
    return stored(spark, "pooled", config, lambda: R.pooled_refits(matches(spark, sf), REFIT_EVERY, test_seasons(spark, sf)))


@query
def pooled_strengths(spark, sf):
    """M2: partially pooled attack, defence and home advantage, refitted every ten matches."""
    return out(pooled_params(spark, sf), 4)


@query
def pooled_model_backtest(spark, sf):
    """M2 in the blend: pooled expected goals in place of history and form."""
    params = pooled_params(spark, sf)
    c = recent_comps(spark, sf).withColumn("cutoff", R.refit_of(F.col("match_seq"), REFIT_EVERY))
    g = R.pooled_goals(c, params, ["league", "cutoff"])
    known = F.col("xh_pooled").isNotNull() & F.col("xa_pooled").isNotNull()
    pooled = g.withColumns({f"x{s}_{k}": F.when(known, F.col(f"x{s}_pooled")).otherwise(F.col(f"x{s}_{k}")) for s in "ha" for k in ("hist", "form")})
    both = production(c).withColumn("model", F.lit("goals")).select("model", "season", "actual", "p1", "px", "p2").unionByName(
        production(pooled).withColumn("model", F.lit("pooled")).select("model", "season", "actual", "p1", "px", "p2"))
    return out(M.metrics(M.scored(both), ["model", "season"]), 4)


def externally_scored(spark, sf) -> DataFrame:
    """Matches with external goals of both teams in place of theirs, without prices."""
    # the numbers of both teams travel along, so that no second join brings them back
    named = matches(spark, sf).select(
        *KEY, "d", *[F.concat(F.lit("T"), F.col(s).cast("string")).alias(s) for s in ("home", "away")],
        F.col("home").alias("_home"), F.col("away").alias("_away"))
    x = Q.join_external_goals(named, external_goals(spark, sf), {"FC Zero": "T0"})
    return x.select(*KEY, "d", F.col("_home").alias("home"), F.col("_away").alias("away"), F.col("xg_home").alias("gh"), F.col("xg_away").alias("ga"))


@query
def external_goals_backtest(spark, sf):
    """History and form from external goals on strictly earlier days, against real goals."""
    # a state reads its matches several times, so they are stored once joined
    covered = stored(spark, "external", {"sf": sf}, lambda: externally_scored(spark, sf))
    cfg = FeatureConfig(lookback=None, min_history=0, league_means="running", order="day")
    e = components(covered, cfg, recent_seasons(spark, sf), market=False).select("league", "match_seq", *[F.col(f"x{s}_{k}").alias(f"_x{s}_{k}") for s in "ha" for k in ("hist", "form")])
    c = recent_comps(spark, sf).join(e, ["league", "match_seq"])
    swapped = c.withColumns({f"x{s}_{k}": F.col(f"_x{s}_{k}") for s in "ha" for k in ("hist", "form")})
    both = production(c).withColumn("model", F.lit("goals")).unionByName(production(swapped).withColumn("model", F.lit("external")))
    return out(M.metrics(M.scored(both), ["model", "season"]))


HOME_LEAGUE = 0


def _feature_rows(spark, sf) -> DataFrame:
    """Features with every group, and the probabilities of the statistical model."""
    c = production(comps(spark, sf)).withColumnsRenamed({"p1": "s1", "px": "sx", "p2": "s2"})
    config = {"sf": sf, "groups": GROUPS, **FeatureConfig().key()}
    return stored(spark, "features", config, lambda: FG.grouped_features(
        c, matches(spark, sf), GROUPS, rated_matches(spark, sf), ["s1", "sx", "s2"], block_rows=blocks.team_blocks(matches(spark, sf), 16)))


def _summary(p: DataFrame, model: str) -> DataFrame:
    s = M.scored(p, "first")
    return s.agg(*M.metric_columns()).select(F.lit(model).alias("model"), "n", "accuracy", "rps", "logloss")


@query
def boosted_trees(spark, sf):
    """M3 M4: boosted trees on the components, all leagues, last season as test; feature groups off and on."""
    f = _feature_rows(spark, sf)
    train, test = L.training_window(f, last_season(spark, sf)), f.where(F.col("season") == last_season(spark, sf))
    sets = {"components": (), "with ratings": ("ratings",), "with all groups": GROUPS}
    models = {name: L.OneVsRestTrees(FG.feature_columns(groups)) for name, groups in sets.items()}
    L.together(spark, [lambda m=m: m.fit(train) for m in models.values()])
    parts = [_summary(m.predict(test), name) for name, m in models.items()]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def league_pooling(spark, sf):
    """One league's own history against added rows of the other leagues."""
    f = _feature_rows(spark, sf)
    own = L.training_window(f.where(F.col("league") == HOME_LEAGUE), last_season(spark, sf))
    wide = own.unionByName(L.league_pool(L.training_window(f, last_season(spark, sf)), HOME_LEAGUE))
    test = f.where((F.col("season") == last_season(spark, sf)) & (F.col("league") == HOME_LEAGUE))
    a = L.OneVsRestTrees(L.FEATURES).fit(own).predict(test).select(*KEY, "actual", "p1", "px", "p2")
    b = L.OneVsRestTrees(L.FEATURES).fit(wide).predict(test).select(*KEY, "actual", "p1", "px", "p2")
    r = C.report(C.pair_1x2(C.paired(b, a, KEY)).withColumn("scope", F.lit("pooled vs own league")), ["scope"], _cell())
    return out(r)


@query
def stacking(spark, sf):
    """Out-of-fold stacking against boosted trees and the statistical model."""
    f = _feature_rows(spark, sf)
    test = F.col("season") == last_season(spark, sf)
    config = {"sf": sf, "features": FG.feature_columns(["ratings"]), "folds": L.FOLDS}
    p = stored(spark, "stacked", config, lambda: L.stack(L.training_window(f, last_season(spark, sf)), f.where(test), config["features"]))
    stat, base, meta = ("s1", "sx", "s2"), ("g1", "gx", "g2"), ("p1", "px", "p2")
    parts = None
    for name, a, b in (("stacking vs statistical", meta, stat), ("trees vs statistical", base, stat), ("stacking vs trees", meta, base)):
        x = C.pair_1x2(p.select(*KEY, "actual", *_sides(a, b))).select(F.lit(name).alias("scope"), *KEY, "ok_a", "ok_b", "score_a", "score_b")
        parts = x if parts is None else parts.unionByName(x)
    return out(C.report(parts, ["scope"], _cell()))
