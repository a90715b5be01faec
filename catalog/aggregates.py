"""Aggregate, mover and trend queries (A and J rows, and related D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock.functions.exact import dollars
from paddock.functions.measures import head_weighted_avg
from paddock.operators import aggregates as agg
from paddock.plans.dashboard import dashboard_summary, dashboard_widgets
from paddock.sources.star import star_lots
from paddock.streaming.sync import freshness_status

from . import AS_OF, DATE_FROM, query
from .expected import avg_e4, half_up, heads, lots, ratio

PRICED = "NOT is_summary AND ppl IS NOT NULL"
SINCE_30 = "report_date BETWEEN DATE '2001-07-31' - 30 AND DATE '2001-07-31'"
SINCE_90 = "report_date BETWEEN DATE '2001-07-31' - 90 AND DATE '2001-07-31'"
NOW = "report_date BETWEEN DATE '2001-07-17' AND DATE '2001-07-31'"
BEFORE = "report_date >= DATE '2001-07-03' AND report_date < DATE '2001-07-17'"
BOTH = "report_date BETWEEN DATE '2001-07-03' AND DATE '2001-07-31'"
TREND_NEEDS = "report_date species commodity animal_class avg_weight market_name price_per_lb_e4 head_count is_summary"


def exact_avg(where: str) -> str:
    """Unrounded head-weighted mean in 1e-4 dollars."""
    return (
        f"CAST(sum(ppl * hw) FILTER ({where}) AS BIGINT) / "
        f"nullif(CAST(sum(hw) FILTER ({where}) AS BIGINT), 0)"
    )


def change(now: str = "now_avg", before: str = "before_avg") -> str:
    return f"CASE WHEN {before} > 0 THEN ({now} - {before}) / {before} * 100 END"


def trend(x: str = "change") -> str:
    return f"CASE WHEN {x} >= 2 THEN 'up' WHEN {x} <= -2 THEN 'down' WHEN {x} IS NOT NULL THEN 'flat' END"


def sign(x: str = "change") -> str:
    return f"CASE WHEN {x} > 0 THEN 'up' WHEN {x} < 0 THEN 'down' WHEN {x} = 0 THEN 'flat' END"


@query("head_weighted_avg", lots(f"""
    SELECT species, animal_class, {avg_e4()} / 10000 AS avg_price_per_lb FROM lots GROUP BY ALL"""))
def head_avg(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "species animal_class price_per_lb_e4 head_count")
    return rows.groupBy("species", "animal_class").agg(
        dollars(head_weighted_avg()).alias("avg_price_per_lb")
    )


@query("species_avg", lots(f"""
    SELECT species, {avg_e4()} / 10000 AS avg_price_per_lb, count(*) AS lot_count
    FROM lots WHERE NOT is_summary AND {NOW} AND buyer_intent = 'meat' GROUP BY species"""))
def species_avg(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "species buyer_intent report_date price_per_lb_e4 head_count is_summary")
    return agg.species_avg(rows, DATE_FROM, AS_OF)


@query("volume_summary", lots(f"""
    SELECT count(*) AS lots, count(DISTINCT market_name) AS markets, count(DISTINCT market_state) AS states
    FROM lots WHERE NOT is_summary AND {NOW}"""))
def volume_summary(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "market_name market_state report_date is_summary")
    return agg.volume_summary(rows, DATE_FROM, AS_OF)


@query("data_freshness", lots("""
    SELECT strftime(max(published_date), '%Y-%m-%dT%H:%M:%S') AS data_freshness FROM lots"""))
def data_freshness(spark, sf_dir):
    return agg.data_freshness(star_lots(spark, sf_dir, "published_date"))


MOVERS = f"""
    SELECT species, animal_class, {exact_avg(NOW)} AS now_avg, {exact_avg(BEFORE)} AS before_avg,
      count(*) FILTER ({NOW}) AS now_lots, count(*) FILTER ({BEFORE}) AS before_lots
    FROM lots WHERE {PRICED} AND {BOTH} GROUP BY ALL
    HAVING now_lots >= 5 AND before_lots >= 5"""
MOVER_COLUMNS = f"""species, animal_class, now_lots, before_lots, {half_up('change', 1)} AS change_pct,
      {sign()} AS direction"""

SUMMARY = f"""
    SELECT (SELECT count(*) FROM lots WHERE NOT is_summary AND {NOW}) AS total_lots,
      (SELECT count(DISTINCT market_name) FROM lots WHERE NOT is_summary AND {NOW}) AS total_markets,
      (SELECT count(DISTINCT market_state) FROM lots WHERE NOT is_summary AND {NOW}) AS total_states,
      (SELECT {ratio('CAST(sum(ppl * hw) AS BIGINT)', 'CAST(100 * sum(hw) AS BIGINT)')} / 100 FROM lots
        WHERE {PRICED} AND {NOW} AND buyer_intent = 'meat' AND species = 'Goats') AS goats_avg,
      (SELECT {ratio('CAST(sum(ppl * hw) AS BIGINT)', 'CAST(100 * sum(hw) AS BIGINT)')} / 100 FROM lots
        WHERE {PRICED} AND {NOW} AND buyer_intent = 'meat' AND species = 'Sheep') AS sheep_avg,
      m.species AS mover_species, m.animal_class AS mover_class, m.change_pct AS mover_pct,
      m.direction AS mover_direction,
      (SELECT strftime(max(published_date), '%Y-%m-%dT%H:%M:%S') FROM lots) AS data_freshness
    FROM (SELECT 1) LEFT JOIN (SELECT {MOVER_COLUMNS} FROM (SELECT *, {change()} AS change FROM ({MOVERS}))
      WHERE change IS NOT NULL ORDER BY change DESC, species, animal_class LIMIT 1) m ON true"""
SUMMARY_NEEDS = (
    "species animal_class buyer_intent market_name market_state report_date published_date "
    "price_per_lb_e4 head_count is_summary"
)


@query("dashboard_summary", lots(SUMMARY))
def summary(spark, sf_dir):
    return dashboard_summary(star_lots(spark, sf_dir, SUMMARY_NEEDS), DATE_FROM, AS_OF)


@query("dashboard_widgets", lots("""
    SELECT * FROM (
      SELECT 1 AS place, '🐐 Goats' AS label, '$' || printf('%.2f', goats_avg) || '/lb' AS value,
        'Slaughter Avg' AS sub_label, CAST(NULL AS DOUBLE) AS trend_pct, CAST(NULL AS VARCHAR) AS trend_direction FROM s
      UNION ALL
      SELECT 2, '🐑 Sheep', '$' || printf('%.2f', sheep_avg) || '/lb', 'Slaughter Avg', NULL, NULL FROM s
      UNION ALL
      SELECT 3, '📊 Volume', format('{:,}', total_lots) || ' lots',
        total_markets || ' markets · ' || total_states || ' states', NULL, NULL FROM s
      UNION ALL
      SELECT 4, '🔥 Top Mover', mover_class, mover_species, mover_pct, mover_direction FROM s)
    WHERE value IS NOT NULL""", s=SUMMARY))
def widgets(spark, sf_dir):
    rows = star_lots(spark, sf_dir, SUMMARY_NEEDS)
    return dashboard_widgets(dashboard_summary(rows, DATE_FROM, AS_OF))


def compared(where: str, keys: str = "market_name, market_state") -> str:
    head_num = "CAST(sum(pph * hw) FILTER (pph IS NOT NULL) AS BIGINT)"
    head_den = "CAST(sum(hw) FILTER (pph IS NOT NULL) AS BIGINT)"
    return lots(f"""
    SELECT {keys}, {avg_e4()} / 10000 AS avg_price_per_lb,
      {ratio(head_num, head_den)} / 100 AS avg_price_per_head,
      count(*) AS lot_count, {heads()} AS head_count
    FROM lots WHERE {PRICED} AND {where} GROUP BY {keys} HAVING count(*) >= 2""")


COMPARE_NEEDS = (
    "market_name market_state market_city report_date species animal_class avg_weight "
    "price_per_lb_e4 price_per_head_e4 head_count is_summary"
)


@query("compare_markets", compared(f"species = 'Goats' AND {SINCE_30}"))
def compare_markets(spark, sf_dir):
    return agg.compare_markets(star_lots(spark, sf_dir, COMPARE_NEEDS), AS_OF, "Goats")


@query("compare_markets_profile", compared(
    "species = 'Sheep' AND animal_class = 'Ewes' AND avg_weight BETWEEN 100 AND 260 "
    "AND report_date BETWEEN DATE '2001-07-31' - 365 AND DATE '2001-07-31'"))
def compare_markets_profile(spark, sf_dir):
    """Of one class in one weight range over a year."""
    rows = star_lots(spark, sf_dir, COMPARE_NEEDS)
    return agg.compare_markets(
        rows, AS_OF, "Sheep", animal_class="Ewes", weight_min=100, weight_max=260, period=365
    )


@query("having_min_lots", lots(f"""
    SELECT market_name, species, animal_class, count(*) AS lot_count FROM lots
    WHERE {PRICED} AND {SINCE_90} GROUP BY ALL HAVING count(*) >= 5"""))
def having_min_lots(spark, sf_dir):
    from paddock.operators.filters import date_window, priced_per_lb

    rows = date_window(priced_per_lb(star_lots(spark, sf_dir, TREND_NEEDS)), AS_OF, 90)
    groups = rows.groupBy("market_name", "species", "animal_class").agg(F.count("*").alias("lot_count"))
    return groups.filter("lot_count >= 5")


@query("compare_by", compared(f"species = 'Sheep' AND {SINCE_90}", "market_state"))
def compare_by_state(spark, sf_dir):
    rows = star_lots(spark, sf_dir, COMPARE_NEEDS)
    return agg.compare_markets(rows, AS_OF, "Sheep", period=90, group_by=["market_state"])


@query("compare_by_rollup", lots(f"""
    SELECT market_city AS region, market_state, market_name,
      CAST(grouping(market_city, market_state, market_name) AS BIGINT) AS level,
      {avg_e4()} / 10000 AS avg_price_per_lb, count(*) AS lot_count, {heads()} AS head_count
    FROM lots WHERE {PRICED} AND species = 'Sheep' AND {SINCE_90}
    GROUP BY ROLLUP (market_city, market_state, market_name) HAVING count(*) >= 2"""))
def compare_by_rollup(spark, sf_dir):
    return agg.compare_by_region(star_lots(spark, sf_dir, COMPARE_NEEDS), AS_OF, "Sheep", 90)


@query("compare_trend", lots(f"""
    SELECT market_name, market_state, avg_price_per_lb, avg_price_per_head, lot_count, head_count,
      {half_up('change', 1)} AS trend_pct, {trend()} AS trend_direction
    FROM (SELECT *, {change()} AS change FROM (
      SELECT market_name, market_state, {avg_e4(where=SINCE_30)} / 10000 AS avg_price_per_lb,
        {avg_e4('pph', SINCE_30)} / 100 AS avg_price_per_head, {heads(SINCE_30)} AS head_count,
        {exact_avg(SINCE_30)} AS now_avg, {exact_avg("report_date < DATE '2001-07-01'")} AS before_avg,
        count(*) FILTER ({SINCE_30}) AS lot_count
      FROM lots WHERE {PRICED} AND species = 'Goats'
        AND report_date BETWEEN DATE '2001-07-31' - 60 AND DATE '2001-07-31'
      GROUP BY ALL)) WHERE lot_count >= 2"""))
def compare_trend(spark, sf_dir):
    return agg.compare_trend(star_lots(spark, sf_dir, COMPARE_NEEDS), AS_OF, "Goats")


@query("trend_direction", lots(f"""
    SELECT species, animal_class, {half_up('change', 1)} AS change_pct, {trend()} AS trend
    FROM (SELECT *, {change()} AS change FROM ({MOVERS})) WHERE change IS NOT NULL"""))
def trend_direction(spark, sf_dir):
    from paddock.functions.measures import trend_direction as direction

    movers = agg.top_movers(star_lots(spark, sf_dir, TREND_NEEDS), DATE_FROM, AS_OF)
    return movers.select(
        "species", "animal_class", "change_pct", direction(F.col("change"), 2.0).alias("trend")
    )


def weekly(where: str) -> str:
    return lots(f"""
    SELECT strftime(report_date, '%Y-W%W') AS week_label, min(day) AS week_start,
      {avg_e4()} / 10000 AS avg_price_per_lb, min(ppl) / 10000 AS price_min, max(ppl) / 10000 AS price_max,
      count(*) AS lot_count, {heads()} AS head_count
    FROM lots WHERE {PRICED} AND {where} GROUP BY 1""")


@query("weekly_trend", weekly(SINCE_90))
def weekly_trend(spark, sf_dir):
    """All auction lots of the last 90 days."""
    return agg.weekly_trend(star_lots(spark, sf_dir, TREND_NEEDS), AS_OF)


@query("weekly_trend_filtered", weekly(
    "species = 'Sheep' AND commodity = 'Slaughter Sheep/Lambs' AND animal_class = 'Hair Breeds' "
    "AND avg_weight BETWEEN 80 AND 250 AND report_date BETWEEN DATE '2001-07-31' - 365 AND DATE '2001-07-31'"))
def weekly_trend_filtered(spark, sf_dir):
    return agg.weekly_trend(
        star_lots(spark, sf_dir, TREND_NEEDS), AS_OF, species="Sheep",
        commodity="Slaughter Sheep/Lambs", animal_class="Hair Breeds",
        weight_min=80, weight_max=250, period=365,
    )


@query("weekly_trend_market", weekly(
    "market_name = 'Supplier#000000003' AND report_date BETWEEN DATE '2001-07-31' - 365 AND DATE '2001-07-31'"))
def weekly_trend_market(spark, sf_dir):
    rows = star_lots(spark, sf_dir, TREND_NEEDS)
    return agg.weekly_trend(rows, AS_OF, market="Supplier#000000003", period=365)


@query("lot_trend_5w", lots(f"""
    SELECT strftime(l.report_date, '%Y-W%W') AS week_label, min(l.day) AS week_start,
      {avg_e4('l.ppl').replace('hw', 'l.hw')} / 10000 AS avg_price_per_lb, min(l.ppl) / 10000 AS price_min,
      max(l.ppl) / 10000 AS price_max, count(*) AS lot_count,
      CAST(coalesce(sum(coalesce(l.head_count, 0)), 0) AS BIGINT) AS head_count
    FROM lots l JOIN (SELECT * FROM lots WHERE id = (SELECT max(id) FROM lots WHERE {PRICED})) o
      ON l.market_name = o.market_name AND l.commodity = o.commodity AND l.animal_class = o.animal_class
      AND l.weight_break_low = o.weight_break_low AND l.weight_break_high = o.weight_break_high
      AND l.report_date <= o.report_date AND l.report_date > o.report_date - 35
    WHERE NOT l.is_summary AND l.ppl IS NOT NULL GROUP BY 1"""))
def lot_trend_5w(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id report_month weight_break_low weight_break_high " + TREND_NEEDS)
    key = rows.filter("not is_summary and price_per_lb_e4 is not null").agg(F.max("id")).first()[0]
    return agg.lot_trend(rows, key)


@query("feeder_vs_slaughter", lots(f"""
    SELECT week_label, feeder / 10000 AS feeder_avg, meat / 10000 AS slaughter_avg, (feeder - meat) / 10000 AS spread
    FROM (SELECT strftime(report_date, '%Y-W%W') AS week_label,
        {avg_e4(where="buyer_intent = 'feeder'")} AS feeder, {avg_e4(where="buyer_intent = 'meat'")} AS meat
      FROM lots WHERE {PRICED} AND {SINCE_90} AND buyer_intent IN ('feeder', 'meat') GROUP BY 1)"""))
def feeder_vs_slaughter(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "report_date buyer_intent price_per_lb_e4 head_count is_summary")
    return agg.feeder_vs_slaughter(rows, AS_OF)


@query("facet_classes", lots("""
    SELECT animal_class AS name, count(*) AS count FROM lots
    WHERE NOT is_summary AND species = 'Goats' AND buyer_intent = 'meat' GROUP BY 1"""))
def facet_classes(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "animal_class species buyer_intent is_summary")
    return agg.facet_classes(rows, "Goats", "meat")


@query("facet_markets", lots("""
    SELECT market_name AS name, min(market_state) AS state, min(market_city) AS city, count(*) AS count
    FROM lots WHERE NOT is_summary GROUP BY 1"""))
def facet_markets(spark, sf_dir):
    return agg.facet_markets(star_lots(spark, sf_dir, "market_name market_state market_city is_summary"))


@query("facet_states", lots(
    "SELECT market_state AS code, count(*) AS count FROM lots WHERE NOT is_summary GROUP BY 1"))
def facet_states(spark, sf_dir):
    return agg.facet_states(star_lots(spark, sf_dir, "market_state is_summary"))


@query("facet_grades", lots("""
    SELECT quality_grade AS name, count(*) AS count FROM lots
    WHERE NOT is_summary AND quality_grade IS NOT NULL GROUP BY 1"""))
def facet_grades(spark, sf_dir):
    return agg.facet_grades(star_lots(spark, sf_dir, "quality_grade is_summary"))


@query("facets", lots("""
    SELECT 'class' AS facet, animal_class AS value, count(*) AS count FROM lots WHERE NOT is_summary GROUP BY 2
    UNION ALL SELECT 'state', market_state, count(*) FROM lots WHERE NOT is_summary GROUP BY 2
    UNION ALL SELECT 'grade', quality_grade, count(*) FROM lots
      WHERE NOT is_summary AND quality_grade IS NOT NULL GROUP BY 2"""))
def facets(spark, sf_dir):
    return agg.facets(star_lots(spark, sf_dir, "animal_class market_state quality_grade is_summary"))


@query("class_by_intent", lots("""
    SELECT species, buyer_intent, animal_class, count(*) AS count FROM lots WHERE NOT is_summary GROUP BY ALL"""))
def class_by_intent(spark, sf_dir):
    return agg.class_by_intent(star_lots(spark, sf_dir, "species buyer_intent animal_class is_summary"))


@query("class_taxonomy", lots("""
    SELECT species, animal_class, nullif(count(*) FILTER (buyer_intent = 'meat'), 0) AS slaughter,
      nullif(count(*) FILTER (buyer_intent = 'feeder'), 0) AS feeder,
      nullif(count(*) FILTER (buyer_intent = 'breeding'), 0) AS replacement, count(*) AS total
    FROM lots GROUP BY ALL"""))
def class_taxonomy(spark, sf_dir):
    return agg.class_taxonomy(star_lots(spark, sf_dir, "species animal_class buyer_intent"))


@query("grade_distribution", lots(f"""
    SELECT quality_grade, n AS count, {half_up('n * 100.0::DOUBLE / sum(n) OVER ()')} AS share_pct
    FROM (SELECT quality_grade, count(*) AS n FROM lots WHERE quality_grade IS NOT NULL GROUP BY 1)"""))
def grade_distribution(spark, sf_dir):
    return agg.grade_distribution(star_lots(spark, sf_dir, "quality_grade"))


@query("top_mover", lots(f"""
    SELECT {MOVER_COLUMNS} FROM (SELECT *, {change()} AS change FROM ({MOVERS}))
    WHERE change IS NOT NULL ORDER BY change DESC, species, animal_class LIMIT 1"""))
def top_mover(spark, sf_dir):
    return agg.top_mover(star_lots(spark, sf_dir, TREND_NEEDS), DATE_FROM, AS_OF)


@query("top_movers", lots(f"""
    SELECT {MOVER_COLUMNS} FROM (SELECT *, {change()} AS change FROM ({MOVERS})) WHERE change IS NOT NULL"""))
def top_movers(spark, sf_dir):
    return agg.top_movers(star_lots(spark, sf_dir, TREND_NEEDS), DATE_FROM, AS_OF).drop("change")


@query("mover_by_commodity", lots(f"""
    SELECT commodity, {MOVER_COLUMNS} FROM (SELECT *, {change()} AS change FROM (
      {MOVERS.replace('SELECT species', 'SELECT commodity, species')}))
    WHERE change IS NOT NULL ORDER BY change DESC, species, commodity, animal_class LIMIT 1"""))
def mover_by_commodity(spark, sf_dir):
    rows = star_lots(spark, sf_dir, TREND_NEEDS)
    return agg.top_mover(rows, DATE_FROM, AS_OF, ["species", "commodity", "animal_class"])


@query("species_avg_trend", lots(f"""
    SELECT species, avg_price_per_lb, {half_up('change', 1)} AS trend_pct, {trend()} AS trend_direction
    FROM (SELECT *, {change()} AS change FROM (
      SELECT species, {avg_e4(where=NOW)} / 10000 AS avg_price_per_lb,
        {exact_avg(NOW)} AS now_avg, {exact_avg(BEFORE)} AS before_avg
      FROM lots WHERE {PRICED} AND {BOTH} AND buyer_intent = 'meat' GROUP BY species))"""))
def species_avg_trend(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "buyer_intent " + TREND_NEEDS)
    return agg.species_avg_trend(rows, DATE_FROM, AS_OF)


@query("freshness_status", lots("""
    SELECT strftime(max(published_date), '%Y-%m-%dT%H:%M:%S') AS data_as_of,
      '2001-07-31T12:00:00' AS last_sync, '2001-07-31T18:00:00' AS next_sync,
      '2001-04-22' AS window_from, '2001-07-31' AS window_to FROM lots"""))
def freshness(spark, sf_dir):
    return freshness_status(star_lots(spark, sf_dir, "published_date"), "2001-07-31 12:00:00")
