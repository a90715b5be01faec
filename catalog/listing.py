"""Listing, lookup, top-k and suggestion queries (L and G rows, and related D rows)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from paddock.operators import aggregates, distributions, listing, suggestions as sug
from paddock.sources.star import star_lots, star_rows, table

from . import AS_OF, query
from .expected import PUBLIC_COLUMNS, lots, public, raw

WHERE = "species = 'Goats' AND avg_weight >= 60 AND NOT is_summary"
CONDITIONS = {"species": "Goats", "weight_min": 60}


@query("list_lots", lots(f"""
    SELECT {public()} FROM (SELECT * FROM lots WHERE {WHERE}
      ORDER BY ppl DESC NULLS LAST, id LIMIT 50 OFFSET 100)"""))
def list_lots(spark, sf_dir):
    """Third page, dearest per pound first."""
    rows = star_lots(spark, sf_dir)
    return listing.list_lots(rows, sort_by="price_per_lb", page=3, limit=50, **CONDITIONS)


@query("list_lots_ascending", lots(f"""
    SELECT {public()} FROM (SELECT * FROM lots WHERE animal_class = 'Kids' AND NOT is_summary
      ORDER BY head_count ASC NULLS FIRST, id LIMIT 200)"""))
def list_lots_ascending(spark, sf_dir):
    rows = star_lots(spark, sf_dir)
    return listing.list_lots(rows, sort_by="head_count", sort_dir="asc", limit=200, animal_class="Kids")


@query("list_lots_after", lots(f"""
    SELECT {public()} FROM (SELECT * FROM lots WHERE {WHERE}
      AND (report_date < DATE '2000-06-01' OR (report_date = DATE '2000-06-01' AND id > '5'))
      ORDER BY report_date DESC, id LIMIT 50)"""))
def list_lots_after(spark, sf_dir):
    """The page after a given lot, at any depth."""
    rows = star_lots(spark, sf_dir)
    return listing.list_lots_after(rows, datetime.date(2000, 6, 1), "5", **CONDITIONS)


@query("page_info", lots(f"""
    SELECT count(*) AS count, 3 AS page, 50 AS limit,
      CAST(greatest(ceil(count(*) / 50), 1) AS BIGINT) AS total_pages FROM lots WHERE {WHERE}"""))
def page_info(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "species avg_weight is_summary avg_price_e4")
    return listing.page_info(rows, page=3, limit=50, **CONDITIONS)


@query("lot_count", lots("SELECT count(*) AS lot_count FROM lots"))
def lot_count(spark, sf_dir):
    return listing.lot_count(star_lots(spark, sf_dir, "id"))


@query("get_lot", lots(f"""
    SELECT {public()} FROM lots WHERE id = (SELECT max(id) FROM lots)"""))
def get_lot(spark, sf_dir):
    """The lot with the greatest id, found first and then looked up by key."""
    rows = star_lots(spark, sf_dir)
    newest = star_lots(spark, sf_dir, "id").agg(F.max("id").alias("id")).first()["id"]
    return listing.get_lot(rows, newest)


@query("get_lots", lots(f"""
    SELECT {public()} FROM lots WHERE id IN (SELECT id FROM lots WHERE ppl > 100000 AND head_count = 7)"""))
def get_lots(spark, sf_dir):
    keys = star_lots(spark, sf_dir, "id price_per_lb_e4 head_count").filter(
        "price_per_lb_e4 > 100000 and head_count = 7"
    )
    return listing.get_lots(star_lots(spark, sf_dir), keys)


SCATTER = {
    **PUBLIC_COLUMNS,
    "head_count": "coalesce(head_count, 1)",
}
SCATTER_COLUMNS = (
    "id", "avg_weight", "price_per_lb", "head_count", "commodity", "species", "animal_class",
    "market_name", "report_date",
)


@query("price_weight_scatter", lots(f"""
    SELECT {', '.join(f'{SCATTER[name]} AS {name}' for name in SCATTER_COLUMNS)}
    FROM (SELECT * FROM lots WHERE NOT is_summary AND ppl IS NOT NULL AND avg_weight > 0
      AND species = 'Sheep' AND report_date >= DATE '2001-01-01'
      ORDER BY report_date DESC, id LIMIT 1000)"""))
def price_weight_scatter(spark, sf_dir):
    rows = star_lots(
        spark, sf_dir,
        "id avg_weight price_per_lb_e4 head_count commodity species animal_class market_name report_date is_summary",
    )
    return listing.price_weight_scatter(rows, species="Sheep", date_from="2001-01-01", limit=1000)


@query("nearest_lots", lots(f"""
    SELECT {public()} FROM (SELECT * FROM lots WHERE species = 'Goats' AND NOT is_summary
      AND avg_weight IS NOT NULL ORDER BY abs(avg_weight - 62), id LIMIT 5)"""))
def nearest_lots(spark, sf_dir):
    return listing.nearest_lots(star_lots(spark, sf_dir), 62, species="Goats")


TARGETS = """
    SELECT p_partkey AS target_id, CASE WHEN p_partkey % 2 = 0 THEN 'Goats' ELSE 'Sheep' END AS species,
      CAST(p_size * 31 - 400 AS BIGINT) AS target_weight FROM part"""


@query("nearest_lots_many", lots("""
    SELECT target_id, species, target_weight, place, id, avg_weight, distance, dearest AS avg_price_e4
    FROM targets JOIN ranked USING (species, target_weight) WHERE place <= 7""", targets=TARGETS, ranked="""
    SELECT t.species, target_weight, id, avg_weight, cents * 100 AS dearest, abs(avg_weight - target_weight) AS distance,
      row_number() OVER (PARTITION BY t.species, target_weight ORDER BY abs(avg_weight - target_weight), id) AS place
    FROM (SELECT DISTINCT species, target_weight FROM targets) t JOIN lots ON t.species = lots.species
    WHERE NOT is_summary AND avg_weight IS NOT NULL"""))
def nearest_lots_many(spark, sf_dir):
    """Seven lots for every part's own weight, some of them far from any lot."""
    wanted = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as target_id", "if(p_partkey % 2 = 0, 'Goats', 'Sheep') as species",
        "cast(p_size * 31 - 400 as bigint) as target_weight",
    )
    rows = star_lots(spark, sf_dir, "id species avg_weight is_summary avg_price_e4")
    return listing.nearest_lots_many(rows, wanted, 7, columns=["avg_price_e4"])


for column, k, source in (("class", 10, "animal_class"), ("grade", 8, "quality_grade")):

    @query(f"top_{'classes' if column == 'class' else 'grades'}_raw", raw(f"""
        SELECT {source} AS value, count(*) AS count FROM raw WHERE {source} IS NOT NULL
        GROUP BY 1 ORDER BY count DESC, value LIMIT {k}"""))
    def top_raw(spark, sf_dir, source=source, k=k):
        return distributions.top_values(star_rows(spark, sf_dir, [source]), source, k)


@query("facet_topk", lots("""
    SELECT market_state AS code, count(*) AS count FROM lots WHERE NOT is_summary
    GROUP BY 1 ORDER BY count DESC, code LIMIT 8"""))
def facet_topk(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "market_state is_summary")
    return aggregates.facet_topk(aggregates.facet_states(rows), 8)


# --- suggestions ---

SEARCH_NEEDS = "species market_state avg_weight report_date is_summary avg_price_e4"
NOTHING = {
    "species": "Goats", "weight_min": 335, "weight_max": 340, "state": "NATION_3",
    "date_from": "2001-06-01",
}
BASE = "species = 'Goats' AND NOT is_summary"
NEAR = "avg_weight BETWEEN 315 AND 360"
IN_STATE = "market_state = 'NATION_3'"
SINCE = "report_date >= DATE '2001-06-01'"
WEIGHT = "avg_weight BETWEEN 335 AND 340"


@query("suggest_weight", lots(f"""
    SELECT 315 AS low, 360 AS high, count(*) AS count FROM lots
    WHERE {BASE} AND {NEAR} AND {IN_STATE} AND {SINCE} HAVING count(*) > 0"""))
def suggest_weight(spark, sf_dir):
    return sug.suggest_weight(star_lots(spark, sf_dir, SEARCH_NEEDS), **NOTHING)


OTHER = {"species": "Goats", "weight_min": 320, "weight_max": 330, "state": "NOWHERE", "date_from": "2001-01-01"}


@query("suggest_states", lots(f"""
    SELECT market_state AS state, count(*) AS count FROM lots
    WHERE {BASE} AND avg_weight BETWEEN 320 AND 330 AND report_date >= DATE '2001-01-01'
    GROUP BY 1 ORDER BY count DESC, state LIMIT 5"""))
def suggest_states(spark, sf_dir):
    return sug.suggest_states(star_lots(spark, sf_dir, SEARCH_NEEDS), **OTHER)


LATE = {"species": "Goats", "state": "NATION_3", "date_from": "2002-01-01"}


@query("suggest_dates", lots(f"""
    SELECT 'all' AS days, count(*) AS count FROM lots WHERE {BASE} AND {IN_STATE} HAVING count(*) > 0"""))
def suggest_dates(spark, sf_dir):
    return sug.suggest_dates(star_lots(spark, sf_dir, SEARCH_NEEDS), **LATE)


@query("suggest_30_days", lots(f"""
    SELECT 30 AS days, count(*) AS count FROM lots
    WHERE {BASE} AND report_date BETWEEN DATE '2001-07-31' - 30 AND DATE '2001-07-31' HAVING count(*) > 0"""))
def suggest_30_days(spark, sf_dir):
    rows = star_lots(spark, sf_dir, SEARCH_NEEDS)
    return sug.suggest_30_days(rows, AS_OF, species="Goats", date_from="2001-07-31")


@query("suggestions", lots(f"""
    SELECT * FROM (
      SELECT 'weight_expanded' AS kind, CAST(NULL AS VARCHAR) AS state, 315 AS low, 360 AS high, count(*) AS count
      FROM lots WHERE {BASE} AND {NEAR} AND {IN_STATE} AND {SINCE} HAVING count(*) > 0
      UNION ALL
      SELECT 'time_expanded', NULL, NULL, NULL, count(*)
      FROM lots WHERE {BASE} AND {WEIGHT} AND {IN_STATE} HAVING count(*) > 0
      UNION ALL
      SELECT * FROM (SELECT 'states_nearby', market_state, NULL, NULL, count(*) AS n
        FROM lots WHERE {BASE} AND {WEIGHT} AND {SINCE} GROUP BY market_state ORDER BY n DESC, market_state LIMIT 5))
    WHERE NOT EXISTS (SELECT 1 FROM lots WHERE {BASE} AND {WEIGHT} AND {IN_STATE} AND {SINCE})"""))
def suggestions(spark, sf_dir):
    return sug.suggestions(star_lots(spark, sf_dir, SEARCH_NEEDS), **NOTHING)


FAR = {**OTHER, "weight_min": 310}


@query("suggestions_states", lots(f"""
    SELECT 'states_nearby' AS kind, market_state AS state, CAST(NULL AS INTEGER) AS low,
      CAST(NULL AS INTEGER) AS high, count(*) AS count
    FROM lots WHERE {BASE} AND avg_weight BETWEEN 310 AND 330 AND report_date >= DATE '2001-01-01'
    GROUP BY market_state ORDER BY count DESC, state LIMIT 5"""))
def suggestions_states(spark, sf_dir):
    """No such state: only leaving the state open finds lots."""
    return sug.suggestions(star_lots(spark, sf_dir, SEARCH_NEEDS), **FAR)


NOWHERE = {"species": "Goats", "weight_min": 700, "weight_max": 721, "state": "NOWHERE", "date_from": "2001-06-01"}


@query("suggest_nearest", lots(f"""
    SELECT {public()} FROM (SELECT * FROM lots WHERE species = 'Goats' AND NOT is_summary AND avg_weight IS NOT NULL
      ORDER BY abs(avg_weight - 710.5::DOUBLE), id LIMIT 5)
    WHERE NOT EXISTS (SELECT 1 FROM lots WHERE {BASE} AND avg_weight BETWEEN 680 AND 741)"""))
def suggest_nearest(spark, sf_dir):
    """No wider search finds a lot: the five closest in weight are the last offer."""
    return sug.suggest_nearest(star_lots(spark, sf_dir), AS_OF, **NOWHERE)
