"""Distribution queries (A13 to A17 and the schema profile)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paddock import schema as S
from paddock.operators import distributions as dist
from paddock.session import scratch_path
from paddock.sources.profile import profile_of, schema_profile, stored_state, update_profile
from paddock.sources.star import FORMS, star_reports, star_rows

from . import query
from .expected import half_up, raw

COUNTED = {
    "category": "species",
    "commodity": "commodity",
    "state": "market_state",
    "price_unit": "price_unit",
    "market_type": "market_type",
}


def priced_rows(spark, sf_dir, *columns):
    """Raw rows, header and summary rows included, with their price in 1e-4 dollars."""
    rows = star_rows(spark, sf_dir, [*columns, "price_unit", "price_cents"])
    return rows.withColumn("avg_price_e4", F.col("price_cents") * 100)


for key, column in COUNTED.items():

    @query(f"value_counts_{key}", raw(
        f"SELECT {column} AS value, count(*) AS count FROM raw WHERE {column} IS NOT NULL GROUP BY 1"))
    def counts(spark, sf_dir, column=column):
        return dist.value_counts(star_rows(spark, sf_dir, [column]), column)


@query("value_counts_slug", raw("SELECT slug_id, count(*) AS count FROM raw GROUP BY 1"))
def slug_counts(spark, sf_dir):
    return dist.report_counts(star_rows(spark, sf_dir, ["slug_id"]))


for key in ("category", "price_unit", "market_type"):

    @query(f"value_share_{key}", raw(f"""
        SELECT value, n AS count, {half_up('n * 100.0::DOUBLE / sum(n) OVER ()', 1)} AS share_pct
        FROM (SELECT {COUNTED[key]} AS value, count(*) AS n FROM raw GROUP BY 1)"""))
    def share(spark, sf_dir, column=COUNTED[key]):
        return dist.value_share(star_rows(spark, sf_dir, [column]), column)


@query("price_histogram", raw("""
    SELECT species, bin, (low * 40 + (high - low) * bin) / 4000::DOUBLE AS bin_low,
      (low * 40 + (high - low) * (bin + 1)) / 4000::DOUBLE AS bin_high, coalesce(n, 0) AS count
    FROM (SELECT species, low, high, CAST(unnest(range(40)) AS INTEGER) AS bin FROM edges)
    LEFT JOIN (SELECT species, CAST(least(39, (cents - low) * 40 // (high - low)) AS INTEGER) AS bin, count(*) AS n
      FROM cwt JOIN edges USING (species) GROUP BY ALL) USING (species, bin)""").replace(
    "\n)\n", """
),
cwt AS (SELECT species, cents FROM raw WHERE price_unit = 'Per Cwt' AND cents IS NOT NULL),
edges AS (SELECT species, min(cents) AS low, max(cents) AS high FROM cwt GROUP BY 1)
""", 1))
def price_histogram(spark, sf_dir):
    return dist.price_histogram(priced_rows(spark, sf_dir, "species"))


BOX = """
),
cwt AS (SELECT commodity, cents FROM raw WHERE price_unit = 'Per Cwt' AND cents IS NOT NULL),
box AS (SELECT commodity, count(*) AS n, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.5) AS q2,
  quantile_cont(cents, 0.75) AS q3 FROM cwt GROUP BY 1),
fenced AS (SELECT *, cents >= q1 - 1.5::DOUBLE * (q3 - q1) AND cents <= q3 + 1.5::DOUBLE * (q3 - q1) AS inside
  FROM cwt JOIN box USING (commodity))
"""


@query("price_box", raw("""
    SELECT commodity, replace(replace(commodity, 'Sheep/Lambs', 'S/L'), 'Goats', 'G') AS label, n,
      q1 / 100 AS q1, q2 / 100 AS median, q3 / 100 AS q3,
      least(min(cents) FILTER (inside), q1) / 100 AS whisker_low,
      greatest(max(cents) FILTER (inside), q3) / 100 AS whisker_high,
      count(*) FILTER (NOT inside) AS outliers
    FROM fenced GROUP BY commodity, n, fenced.q1, q2, fenced.q3""").replace("\n)\n", BOX, 1))
def price_box(spark, sf_dir):
    return dist.price_box(priced_rows(spark, sf_dir, "commodity"))


@query("price_box_outliers", raw("""
    SELECT commodity, cents / 100 AS price, count(*) AS count FROM fenced WHERE NOT inside GROUP BY ALL""").replace(
    "\n)\n", BOX, 1))
def price_box_outliers(spark, sf_dir):
    return dist.price_box_outliers(priced_rows(spark, sf_dir, "commodity"))


@query("dataset_summary", raw("""
    SELECT count(*) AS total_rows, count(DISTINCT slug_id) AS files,
      strftime(min(report_date), '%Y-%m-%d') AS first_date, strftime(max(report_date), '%Y-%m-%d') AS last_date,
      count(DISTINCT market_state) AS states, count(DISTINCT market_name) AS markets
    FROM raw"""))
def dataset_summary(spark, sf_dir):
    rows = star_rows(spark, sf_dir, ["slug_id", "report_date", "market_state", "market_name"])
    return dist.dataset_summary(rows, "slug_id")


# --- the untidy texts of the report files, as DuckDB has them ---

SPACED = "CASE seq % 3 WHEN 0 THEN {0} WHEN 1 THEN '  ' || {0} || chr(9) ELSE {0} || ' ' || chr(10) END"
NOTHING = "CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '   ' WHEN 3 THEN NULL ELSE 'NaN' END"


def _untidy(name: str) -> str:
    return f"coalesce({SPACED.format(name)}, {NOTHING})"


def _number(name: str, decimals: str = "''") -> str:
    return (
        f"coalesce(CASE WHEN seq % 2 = 0 THEN ' ' ELSE '' END || {name} || {decimals}, "
        "CASE WHEN seq % 2 = 0 THEN 'abc' ELSE 'N/A' END)"
    )


def _money(cents: str) -> str:
    return f"({cents}) // 100 || '.' || lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"


RAW_SQL = {
    "_section": "section",
    "slug_id": "CAST(slug_id AS VARCHAR)",
    "report_date": "CASE seq % 3 WHEN 0 THEN strftime(report_date, '%m/%d/%Y') WHEN 1 THEN strftime(report_date, '%-m/%-d/%Y') "
    "ELSE strftime(report_date, '%Y-%m-%d') END",
    "published_date": "strftime(published_date, '%m/%d/%Y %H:%M:%S')",
    "avg_price": f"coalesce({_money('cents')}, 'N/A')",
    "avg_price_min": _money("cents - spread"),
    "avg_price_max": _money("cents + spread"),
    "avg_weight": _number("avg_weight", "CASE WHEN seq % 3 = 0 THEN '.0' ELSE '' END"),
    "avg_weight_min": _number("weight_min"),
    "avg_weight_max": _number("weight_max"),
    "head_count": _number("head_count", "CASE WHEN seq % 4 = 0 THEN '.9' ELSE '' END"),
    **{
        name: _number(name)
        for name in ("weight_break_low", "weight_break_high", "receipts", "receipts_week_ago", "receipts_year_ago")
    },
    "final_ind": "final_ind",
}
TEXTS_SQL = {raw_name: _untidy(lot) for lot, raw_name in S.TEXT_COLUMNS.items()} | RAW_SQL


def _profile_sql() -> str:
    """All columns of all three forms of file: counts decide the type, nulls make whole numbers floats."""
    note = {"pregnancy": "Related: pregnancy_stage", "pregnancy_stage": "Related: pregnancy"}
    for alias, canonical in S.ALIASES.items():
        note |= {alias: f"Same as {canonical}", canonical: f"Also appears as: {alias}"}
    values = [
        f"SELECT '{spelling.get(name, name)}' AS column_name, CAST(slug_id AS VARCHAR) AS slug, {TEXTS_SQL[name]} AS v "
        f"FROM raw WHERE slug_id % {len(FORMS)} = {i}"
        for i, spelling in enumerate(FORMS.values())
        for name in S.RAW_INPUTS
    ]
    tokens = ", ".join(f"'{token}'" for token in S.NULL_TOKENS)
    notes = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in note.items())
    return f"""
    SELECT column_name, files, (SELECT count(DISTINCT slug_id) FROM raw) AS total_files,
      CASE WHEN filled = 0 THEN 'float64' WHEN whole = filled AND filled = rows THEN 'int64'
        WHEN numeric = filled THEN 'float64' ELSE 'object' END AS dtype,
      CASE WHEN filled > 0 THEN array_to_string(samples[1:3], ' | ') END AS sample_values,
      CASE column_name {notes} END AS duplicate_note,
      array_to_string(slugs[1:8], ', ') || CASE WHEN len(slugs) > 8 THEN '...' ELSE '' END AS slug_ids
    FROM (
      SELECT column_name, count(DISTINCT slug) AS files, count(*) AS rows, count(v) AS filled,
        count(*) FILTER (regexp_matches(trim(v, ' ' || chr(9) || chr(10)), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) AS numeric,
        count(*) FILTER (regexp_matches(trim(v, ' ' || chr(9) || chr(10)), '^[+-]?[0-9]+$')) AS whole,
        list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)) AS samples, list_sort(list(DISTINCT slug)) AS slugs
      FROM (SELECT column_name, slug, CASE WHEN v NOT IN ({tokens}) THEN v END AS v
        FROM ({' UNION ALL '.join(values)}))
      GROUP BY column_name)"""


def profiled_frames(spark, sf_dir):
    """The three forms of file, without the fixture's own id; a report stands for a file."""
    return [
        frame.drop("id").withColumn("source_file", F.col("slug_id"))
        for frame in star_reports(spark, sf_dir).values()
    ]


PROFILE = raw(_profile_sql())


@query("schema_profile", PROFILE)
def profile(spark, sf_dir):
    return schema_profile(profiled_frames(spark, sf_dir))


@query("schema_profile_samples", PROFILE)
def profile_samples(spark, sf_dir):
    """The same from kept states: each form's files are added by a run of their own, some of them twice."""
    path = scratch_path(spark, "profile")
    frames = profiled_frames(spark, sf_dir)
    stale = frames[0].where("slug_id % 2 = 0").withColumn("avg_price", F.lit("0.00 stale"))
    for some in ([stale], frames[:2], frames[2:]):
        update_profile(spark, path, some)
    return profile_of(stored_state(spark, path))
