"""Normalisation and display queries (N rows of the survey, and the row-wise D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import schema as S
from paddock.functions import dates, labels, text
from paddock.functions.exact import dollars
from paddock.functions.prices import display_price, display_unit
from paddock.functions.public import nested_lots, public_lots
from paddock.operators import normalise as norm
from paddock.plans.row_index import dense_positions, with_ordered_seq
from paddock.sources.star import star_lots, star_reports, star_rows

from . import query
from .expected import lots, public, raw

# Text of a value as the fixture's untidy reports hold it.
SPACED = (
    "CASE seq % 3 WHEN 0 THEN {0} WHEN 1 THEN '  ' || {0} || chr(9) ELSE {0} || ' ' || chr(10) END"
)
MONEY = "CAST({0} // 100 AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"


def raw_reports(spark, sf_dir):
    """All report rows as text under canonical names."""
    return norm.union_reports(list(star_reports(spark, sf_dir).values()))


@query("resolve_aliases", raw(f"""
    SELECT id, strftime(published_date, '%m/%d/%Y %H:%M:%S') AS published_date,
      coalesce({MONEY.format('cents')}, 'N/A') AS avg_price,
      {MONEY.format('(cents - spread)')} AS avg_price_min,
      CASE WHEN seq % 2 = 0 THEN ' ' ELSE '' END || CAST(weight_break_low AS VARCHAR) AS weight_break_low
    FROM raw"""))
def resolve_aliases(spark, sf_dir):
    return raw_reports(spark, sf_dir).select(
        "id", "published_date", "avg_price", "avg_price_min", "weight_break_low"
    )


@query("coerce_numeric", raw("""
    SELECT id, cents / 100 AS avg_price, CAST(avg_weight AS DOUBLE) AS avg_weight,
      CASE WHEN seq % 4 = 0 THEN CAST(CAST(head_count AS VARCHAR) || '.9' AS DOUBLE)
        ELSE CAST(head_count AS DOUBLE) END AS head_count
    FROM raw"""))
def coerce_numeric(spark, sf_dir):
    columns = ("avg_price", "avg_weight", "head_count")
    return raw_reports(spark, sf_dir).select(
        "id", *[F.expr(text.coerce_numeric(name)).alias(name) for name in columns]
    )


@query("to_int_trunc", raw("SELECT id, avg_weight, head_count, receipts FROM raw"))
def to_int_trunc(spark, sf_dir):
    columns = ("avg_weight", "head_count", "receipts")
    return raw_reports(spark, sf_dir).select(
        "id", *[F.expr(text.to_int_trunc(text.coerce_numeric(name))).alias(name) for name in columns]
    )


@query("clean_string", raw("""
    SELECT id, animal_class AS class,
      coalesce(quality_grade, CASE seq % 5 WHEN 1 THEN 'N/A' WHEN 4 THEN 'NaN' END) AS quality_grade_name
    FROM raw"""))
def clean_string(spark, sf_dir):
    return raw_reports(spark, sf_dir).select(
        "id", *[F.expr(text.clean_string(name)).alias(name) for name in ("class", "quality_grade_name")]
    )


@query("null_tokens", raw(f"""
    SELECT id, coalesce({SPACED.format('quality_grade')}, CASE seq % 5 WHEN 2 THEN '   ' END) AS quality_grade_name,
      {MONEY.format('cents')} AS avg_price
    FROM raw"""))
def null_tokens(spark, sf_dir):
    return raw_reports(spark, sf_dir).select(
        "id", *[F.expr(text.null_tokens(name)).alias(name) for name in ("quality_grade_name", "avg_price")]
    )


@query("parse_report_date", raw("""
    SELECT id, strftime(report_date, '%Y-%m-%d') AS report_date,
      strftime(published_date, '%Y-%m-%dT%H:%M:%S') AS published_date
    FROM raw"""))
def parse_report_date(spark, sf_dir):
    return raw_reports(spark, sf_dir).select(
        "id",
        dates.iso_date(F.expr(dates.parse_date("report_date"))).alias("report_date"),
        dates.iso_stamp(F.expr(dates.parse_stamp("published_date"))).alias("published_date"),
    )


@query("breed_type", lots("SELECT id, animal_class, breed_type FROM lots"))
def breed_type(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id animal_class")
    return rows.withColumn("breed_type", labels.breed_type(F.col("animal_class")))


@query("buyer_intent", lots("SELECT id, commodity, buyer_intent FROM lots"))
def buyer_intent(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id commodity")
    return rows.withColumn("buyer_intent", labels.buyer_intent(F.col("commodity")))


@query("dimension_lookups", lots("""
    SELECT buyer_intent, breed_type, count(*) AS lots FROM lots GROUP BY ALL"""))
def dimension_lookups(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "buyer_intent breed_type")
    return rows.groupBy("buyer_intent", "breed_type").agg(F.count("*").alias("lots"))


@query("derive_prices", lots(f"SELECT {public(('id', 'price_unit', 'price_per_lb', 'price_per_head', 'price_per_cwt'))} FROM lots"))
def derive_prices(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id price_unit price_per_lb_e4 price_per_head_e4 price_per_cwt_e4")
    return public_lots(rows, ("id", "price_unit", "price_per_lb", "price_per_head", "price_per_cwt"))


@query("lot_id", raw("""
    SELECT id, CAST(slug_id AS VARCHAR) || '-' || strftime(report_date, '%m-%d-%Y') || '-' ||
      CASE WHEN pos < 10000 THEN lpad(CAST(pos AS VARCHAR), 4, '0') ELSE CAST(pos AS VARCHAR) END AS lot_id
    FROM (SELECT *, row_number() OVER (PARTITION BY slug_id ORDER BY published_date, id) - 1 AS pos FROM raw)"""))
def lot_id(spark, sf_dir):
    """Places in a report whose rows come in order of publication and key."""
    rows = star_rows(spark, sf_dir, ["id", "slug_id", "report_date", "published_date"])
    ordered = with_ordered_seq(rows, ["slug_id", "published_date", "id"])
    numbered = dense_positions(ordered, ["slug_id"], "block", "seq", "source_row")
    as_text = numbered.withColumns(
        {"slug_id": F.col("slug_id").cast("string"), "report_date": F.date_format("report_date", "MM/dd/yyyy")}
    )
    return as_text.select("id", norm.lot_id().alias("lot_id"))


@query("drop_non_lots", lots("SELECT id FROM lots"))
def drop_non_lots(spark, sf_dir):
    return norm.drop_non_lots(norm.tidy_rows(raw_reports(spark, sf_dir))).select("id")


@query("dropped_rows", raw("""
    SELECT CASE WHEN section = 'Report Header' THEN 'report header'
      WHEN animal_class IN ('Hogs', 'Sheep') THEN 'excluded class' ELSE 'no price' END AS reason,
      count(*) AS rows
    FROM raw WHERE section = 'Report Header' OR animal_class IN ('Hogs', 'Sheep') OR cents IS NULL
    GROUP BY 1"""))
def dropped_rows(spark, sf_dir):
    return norm.dropped_rows(raw_reports(spark, sf_dir))


@query("summary_flag", lots("SELECT id, is_summary FROM lots"))
def summary_flag(spark, sf_dir):
    return star_lots(spark, sf_dir, "id is_summary")


@query("project_lots", lots(f"SELECT {public()} FROM lots"))
def project_lots(spark, sf_dir):
    """Raw text of three spellings to the 39 public columns."""
    return public_lots(norm.normalise(raw_reports(spark, sf_dir)))


@query("nested_lots", lots("""
    SELECT id, market_state AS state, animal_class AS class, ppl / 10000 AS price_per_lb, head_count
    FROM lots"""))
def nested_view(spark, sf_dir):
    return nested_lots(star_lots(spark, sf_dir)).select(
        "id", "market.state", "animal.class", "pricing.price_per_lb", "volume.head_count"
    )


def _price_text(value: str) -> str:
    return f"'$' || {MONEY.format(value)}"


@query("display_price", lots(f"""
    SELECT id, coalesce({_price_text('((ppl + 50) // 100)')}, '—') AS per_lb,
      coalesce('$' || CAST((pph + 50) // 100 AS VARCHAR), '—') AS per_head,
      {_price_text('coalesce(pcwt, cents)')} AS per_cwt, '/lb' AS lb_unit, '/hd' AS head_unit, '/cwt' AS cwt_unit
    FROM lots"""))
def price_texts(spark, sf_dir):
    rows = star_lots(
        spark, sf_dir, "id avg_price_e4 price_per_lb_e4 price_per_head_e4 price_per_cwt_e4"
    )
    units = ("lb", "head", "cwt")
    return rows.select(
        "id",
        *[display_price(unit).alias(f"per_{unit}") for unit in units],
        *[display_unit(unit).alias(f"{unit}_unit") for unit in units],
    )


@query("receipts_change_pct", lots("""
    SELECT id, receipts, receipts_week_ago,
      CASE WHEN receipts <> 0 THEN CAST(floor((receipts - receipts_week_ago)
        / nullif(receipts_week_ago, 0) * 100::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS change_pct
    FROM lots"""))
def receipts_change_pct(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id receipts receipts_week_ago")
    change = labels.receipts_change_pct(F.col("receipts"), F.col("receipts_week_ago"))
    return rows.withColumn("change_pct", change)


@query("intent_label", lots("""
    SELECT id, CASE buyer_intent WHEN 'meat' THEN 'Slaughter' WHEN 'feeder' THEN 'Feeder'
      WHEN 'breeding' THEN 'Replacement' ELSE 'Other' END AS intent_label FROM lots"""))
def intent_label(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id buyer_intent")
    return rows.select("id", labels.intent_label(F.col("buyer_intent")).alias("intent_label"))


@query("commodity_series", lots("""
    SELECT id, CASE WHEN contains(commodity, 'Slaughter') THEN 'Slaughter'
      WHEN contains(commodity, 'Feeder') THEN 'Feeder' ELSE 'Replacement' END AS series FROM lots"""))
def commodity_series(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id commodity")
    return rows.select(
        "id", labels.commodity_series(F.col("commodity")).alias("series")
    ).filter("series is not null")


@query("commodity_short", lots("""
    SELECT commodity, replace(replace(commodity, 'Sheep/Lambs', 'S/L'), 'Goats', 'G') AS short,
      count(*) AS lots FROM lots GROUP BY ALL"""))
def commodity_short(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "commodity").groupBy("commodity").agg(F.count("*").alias("lots"))
    return rows.withColumn("short", labels.commodity_short(F.col("commodity")))


@query("report_date_label", lots("""
    SELECT id, strftime(report_date, '%b %-d, %Y') AS label FROM lots"""))
def report_date_label(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id report_date")
    return rows.select("id", dates.date_label(F.col("report_date")).alias("label"))


@query("week_label", lots("SELECT id, strftime(report_date, '%Y-W%W') AS week_label FROM lots"))
def week_label(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id report_date")
    return rows.select("id", dates.week_label(F.col("report_date")).alias("week_label"))


@query("outlier_flag", lots("""
    SELECT id, ppl / 10000 AS price_per_lb, coalesce(ppl < 1000 OR ppl > 80000, false) AS is_outlier
    FROM lots"""))
def outlier_flag(spark, sf_dir):
    rows = star_lots(spark, sf_dir, "id price_per_lb_e4")
    return rows.select(
        "id",
        dollars(F.col("price_per_lb_e4")).alias("price_per_lb"),
        labels.outlier_flag(F.col("price_per_lb_e4")).alias("is_outlier"),
    )


@query("keep_final", lots("""
    SELECT id, final_ind FROM (SELECT *, bool_or(final_ind = 'Final')
      OVER (PARTITION BY slug_id, report_date) AS has_final FROM lots)
    WHERE final_ind = 'Final' OR NOT has_final"""))
def keep_final(spark, sf_dir):
    return norm.keep_final(star_lots(spark, sf_dir, "id slug_id report_date final_ind")).select(
        "id", "final_ind"
    )
