"""The fixture binding and the exact-rounding rules, as SQL text."""

from __future__ import annotations

RAW = """
raw AS (
  SELECT
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
              CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS id,
    l_orderkey + l_linenumber AS seq,
    CASE WHEN l_linenumber = 7 THEN 'Report Header' ELSE 'Report Details' END AS section,
    CAST(l_shipdate AS DATE) AS report_date,
    o_orderdate AS published_date,
    s_name AS market_name, r_name AS market_city, n_name AS market_state,
    l_suppkey AS slug_id,
    s_name || ' Sheep & Goat Auction' AS report_title,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Summary' ELSE 'Auction' END AS market_type,
    CASE WHEN l_linestatus = 'F' THEN 'Goats' ELSE 'Sheep' END AS species,
    CASE l_returnflag WHEN 'A' THEN 'Slaughter' WHEN 'N' THEN 'Feeder' ELSE 'Replacement' END
      || CASE WHEN l_linestatus = 'F' THEN ' Goats' ELSE ' Sheep/Lambs' END AS commodity,
    CASE WHEN p_size = 13 THEN 'Hogs'
      WHEN l_linestatus = 'F' THEN CASE p_type WHEN 'ECONOMY' THEN 'Kids' WHEN 'LARGE' THEN 'Nannies/Does'
        WHEN 'MEDIUM' THEN 'Bucks/Billies' WHEN 'PROMO' THEN 'Wethers' WHEN 'SMALL' THEN 'Wether Kids'
        ELSE 'Families' END
      ELSE CASE p_type WHEN 'ECONOMY' THEN 'Hair Breeds' WHEN 'LARGE' THEN 'Wooled & Shorn'
        WHEN 'MEDIUM' THEN 'Ewes' WHEN 'PROMO' THEN 'Hair Ewes' WHEN 'SMALL' THEN 'Lambs'
        ELSE 'Hair Lambs' END END AS animal_class,
    nullif(p_brand, 'Brand#1') AS quality_grade,
    split_part(p_name, ' ', 1) AS lot_desc,
    CASE WHEN l_discount < 0.025::DOUBLE THEN 'High' WHEN l_discount > 0.095::DOUBLE THEN 'Low'
      WHEN l_discount BETWEEN 0.085::DOUBLE AND 0.095::DOUBLE THEN NULL ELSE 'Average' END AS dressing,
    CASE l_linenumber WHEN 2 THEN 'Yearlings (1-2 yrs)' WHEN 3 THEN 'Young (2-4 yrs)' END AS age,
    CASE WHEN l_linenumber <= 4 THEN 'Medium' ELSE 'Medium and Large' END AS frame,
    CASE WHEN p_size < 20 THEN '1-2' WHEN p_size < 40 THEN '2' END AS muscle_grade,
    CASE WHEN p_size < 25 THEN '2-3' END AS yield_grade,
    CASE WHEN p_size % 5 = 0 THEN 'Per Unit' ELSE 'Per Cwt' END AS price_unit,
    CASE WHEN p_size = 49 THEN NULL ELSE
      (CAST(round(p_retailprice * 100) AS BIGINT) // 4 + CAST(round(l_discount * 100) AS BIGINT) * 500)
      * CASE WHEN l_discount > 0.095::DOUBLE AND l_tax < 0.025::DOUBLE THEN 4 ELSE 1 END END AS cents,
    CAST(l_linenumber * 100 AS BIGINT) AS spread,
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size * 6 + 40 AS BIGINT) END AS avg_weight,
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size * 6 + 35 AS BIGINT) END AS weight_min,
    CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_size * 6 + 45 AS BIGINT) END AS weight_max,
    CAST((p_size * 6 + 40) // 50 * 50 AS BIGINT) AS weight_break_low,
    CAST((p_size * 6 + 40) // 50 * 50 + 50 AS BIGINT) AS weight_break_high,
    CAST(CASE WHEN l_tax > 0.075::DOUBLE THEN NULL WHEN l_tax < 0.005::DOUBLE THEN 0
      ELSE l_quantity END AS BIGINT) AS head_count,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS receipts,
    CAST(greatest(0, floor(c_acctbal / 10)) AS BIGINT) AS receipts_week_ago,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(floor(o_totalprice / 900) AS BIGINT) END AS receipts_year_ago,
    'Compared to last sale: ' || p_name || chr(10) || '"steady", light test' AS narrative,
    CASE WHEN o_orderstatus = 'P' THEN 'Preliminary' ELSE 'Final' END AS final_ind
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

LOTS = RAW + """,
lots AS (
  SELECT *,
    market_type = 'Summary' AS is_summary,
    CASE WHEN animal_class IN ('Hair Breeds', 'Hair Ewes', 'Hair Bucks', 'Hair Lambs') THEN 'Hair'
      WHEN animal_class IN ('Wooled & Shorn', 'Wooled', 'Shorn') THEN 'Wooled' END AS breed_type,
    CASE WHEN commodity LIKE 'Slaughter%' THEN 'meat' WHEN commodity LIKE 'Feeder%' THEN 'feeder'
      ELSE 'breeding' END AS buyer_intent,
    CASE WHEN price_unit = 'Per Cwt' THEN cents
      ELSE (cents * 200 + avg_weight) // (2 * avg_weight) END AS ppl,
    CASE WHEN price_unit = 'Per Unit' THEN cents
      ELSE (cents * avg_weight + 50) // 100 END AS pph,
    CASE WHEN price_unit = 'Per Cwt' THEN cents
      ELSE (cents * 200 + avg_weight) // (2 * avg_weight) END AS pcwt,
    coalesce(head_count, 1) AS hw,
    strftime(report_date, '%Y-%m-%d') AS day
  FROM raw
  WHERE section <> 'Report Header' AND animal_class NOT IN ('Hogs', 'Sheep') AND cents IS NOT NULL
)"""

PUBLIC_COLUMNS = {
    "id": "id",
    "report_date": "day",
    "published_date": "strftime(published_date, '%Y-%m-%dT%H:%M:%S')",
    **{name: name for name in (
        "market_name", "market_city", "market_state", "slug_id", "report_title", "market_type",
        "is_summary", "species", "commodity", "animal_class", "breed_type", "quality_grade",
        "lot_desc", "dressing", "age", "frame", "muscle_grade", "yield_grade", "price_unit",
    )},
    "avg_price": "cents / 100",
    "price_min": "(cents - spread) / 100",
    "price_max": "(cents + spread) / 100",
    "price_per_lb": "ppl / 10000",
    "price_per_head": "pph / 100",
    "price_per_cwt": "pcwt / 100",
    **{name: name for name in (
        "avg_weight", "weight_min", "weight_max", "weight_break_low", "weight_break_high",
        "head_count", "receipts", "receipts_week_ago", "receipts_year_ago",
        "buyer_intent", "narrative",
    )},
}


def public(names=tuple(PUBLIC_COLUMNS)) -> str:
    return ", ".join(f"{PUBLIC_COLUMNS[name]} AS {name}" for name in names)


def ratio(num: str, den: str) -> str:
    """Whole-number quotient, halves up; null for zero."""
    return f"(2 * ({num}) + ({den})) // nullif(2 * ({den}), 0)"


def avg_e4(price: str = "ppl", where: str = "true") -> str:
    """Head-weighted mean in the price's own unit."""
    num = f"CAST(sum({price} * hw) FILTER ({where} AND {price} IS NOT NULL) AS BIGINT)"
    den = f"CAST(sum(hw) FILTER ({where} AND {price} IS NOT NULL) AS BIGINT)"
    return ratio(num, den)


def heads(where: str = "true") -> str:
    return f"CAST(coalesce(sum(coalesce(head_count, 0)) FILTER ({where}), 0) AS BIGINT)"


def half_up(x: str, digits: int = 0) -> str:
    scale = float(10**digits)
    return f"floor(({x}) * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE"


def lots(query: str, **more: str) -> str:
    """``query`` over the fixture's lots, and over the further tables given."""
    tables = "".join(f",\n{name} AS ({table})" for name, table in more.items())
    return f"WITH {LOTS}{tables}\n{query}"


def raw(query: str) -> str:
    return f"WITH {RAW}\n{query}"
