"""Lots bound to the star-schema tables the tests and benchmarks run on.

A lot is an order line; market, report and class come from its dimensions.  The
dimension keys are declared unique and the foreign keys whole, so a dimension is
joined only when a requested column comes from it; which joins are broadcast is
left to the planner's size estimates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import labels
from ..functions.exact import E4
from ..functions.prices import derive_prices

TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, "
    "p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

# Dimension -> (key in the fact or in the dimension before it, own key), in join order.
JOINS = {
    "part": ("l_partkey", "p_partkey"),
    "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"),
    "supplier": ("l_suppkey", "s_suppkey"),
    "nation": ("s_nationkey", "n_nationkey"),
    "region": ("n_regionkey", "r_regionkey"),
}
# Dimension -> a large one that belongs to it.  Short ones are joined to the lots: the planner
# sees that they can be broadcast, but not that what they are joined to can.
BELONGS = {"orders": "customer"}

# Typed values of a raw row: name -> (dimensions besides part, expression).
VALUES = {
    "id": ((), "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"),
    "seq": ((), "l_orderkey + l_linenumber"),
    "section": ((), "if(l_linenumber = 7, 'Report Header', 'Report Details')"),
    "report_date": ((), "cast(l_shipdate as date)"),
    "published_date": (("orders",), "o_orderdate"),
    "market_name": (("supplier",), "s_name"),
    "market_city": (("supplier", "nation", "region"), "r_name"),
    "market_state": (("supplier", "nation"), "n_name"),
    "slug_id": ((), "l_suppkey"),
    "report_title": (("supplier",), "concat(s_name, ' Sheep & Goat Auction')"),
    "market_type": (("orders",), "if(o_orderpriority = '5-LOW', 'Summary', 'Auction')"),
    "species": ((), "if(l_linestatus = 'F', 'Goats', 'Sheep')"),
    "commodity": (
        (),
        "concat(case l_returnflag when 'A' then 'Slaughter' when 'N' then 'Feeder' "
        "else 'Replacement' end, if(l_linestatus = 'F', ' Goats', ' Sheep/Lambs'))",
    ),
    "animal_class": (
        (),
        "case when p_size = 13 then 'Hogs' when l_linestatus = 'F' then "
        "case p_type when 'ECONOMY' then 'Kids' when 'LARGE' then 'Nannies/Does' "
        "when 'MEDIUM' then 'Bucks/Billies' when 'PROMO' then 'Wethers' "
        "when 'SMALL' then 'Wether Kids' else 'Families' end else "
        "case p_type when 'ECONOMY' then 'Hair Breeds' when 'LARGE' then 'Wooled & Shorn' "
        "when 'MEDIUM' then 'Ewes' when 'PROMO' then 'Hair Ewes' "
        "when 'SMALL' then 'Lambs' else 'Hair Lambs' end end",
    ),
    "quality_grade": ((), "nullif(p_brand, 'Brand#1')"),
    "lot_desc": ((), "split_part(p_name, ' ', 1)"),
    "dressing": (
        (),
        "case when l_discount < 0.025 then 'High' when l_discount > 0.095 then 'Low' "
        "when l_discount between 0.085 and 0.095 then null else 'Average' end",
    ),
    "age": (
        (),
        "case l_linenumber when 2 then 'Yearlings (1-2 yrs)' when 3 then 'Young (2-4 yrs)' end",
    ),
    "frame": ((), "if(l_linenumber <= 4, 'Medium', 'Medium and Large')"),
    "muscle_grade": ((), "case when p_size < 20 then '1-2' when p_size < 40 then '2' end"),
    "yield_grade": ((), "case when p_size < 25 then '2-3' end"),
    "price_unit": ((), "if(p_size % 5 = 0, 'Per Unit', 'Per Cwt')"),
    "price_cents": (
        (),
        "if(p_size = 49, null, (cast(round(p_retailprice * 100) as bigint) div 4 "
        "+ cast(round(l_discount * 100) as bigint) * 500) "
        "* if(l_discount > 0.095 and l_tax < 0.025, 4, 1))",
    ),
    "price_spread": ((), "cast(l_linenumber * 100 as bigint)"),
    "avg_weight": ((), "if(p_size = 50, null, cast(p_size * 6 + 40 as bigint))"),
    "weight_min": ((), "if(p_size = 50, null, cast(p_size * 6 + 35 as bigint))"),
    "weight_max": ((), "if(p_size = 50, null, cast(p_size * 6 + 45 as bigint))"),
    "weight_break_low": ((), "cast((p_size * 6 + 40) div 50 * 50 as bigint)"),
    "weight_break_high": ((), "cast((p_size * 6 + 40) div 50 * 50 + 50 as bigint)"),
    "head_count": (
        (),
        "cast(case when l_tax > 0.075 then null when l_tax < 0.005 then 0 "
        "else l_quantity end as bigint)",
    ),
    "receipts": (("orders",), "cast(floor(o_totalprice / 1000) as bigint)"),
    "receipts_week_ago": (
        ("orders", "customer"),
        "cast(greatest(0, floor(c_acctbal / 10)) as bigint)",
    ),
    "receipts_year_ago": (
        ("orders",),
        "if(l_linenumber = 5, null, cast(floor(o_totalprice / 900) as bigint))",
    ),
    "narrative": ((), "concat('Compared to last sale: ', p_name, '\\n\"steady\", light test')"),
    "final_ind": (("orders",), "if(o_orderstatus = 'P', 'Preliminary', 'Final')"),
}

# Lot columns made from other values.
DERIVED = {
    "avg_price_e4": (),
    "price_min_e4": ("price_spread",),
    "price_max_e4": ("price_spread",),
    "price_per_lb_e4": ("price_unit", "avg_weight"),
    "price_per_head_e4": ("price_unit", "avg_weight"),
    "price_per_cwt_e4": ("price_unit", "avg_weight"),
    "is_summary": ("market_type",),
    "breed_type": ("animal_class",),
    "buyer_intent": ("commodity",),
    "report_month": ("report_date",),
    "report_date_raw": ("report_date",),
    "published_date_raw": ("published_date",),
    "report_key": ("slug_id", "report_date"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def star_rows(spark: SparkSession, sf_dir: str, values: Iterable[str], first: str = "part") -> DataFrame:
    """Typed raw rows, one per order line, with the named values.

    Customers are joined to orders first, so that order lines, which are the most and the
    widest rows, are shuffled for parts and orders only.  ``first``: the one that order lines meet
    first.  Conditions on lots mostly ask for values of parts, which leaves fewer lines to shuffle
    for orders; where all lines are wanted, a part's texts are better not shuffled with them.
    """
    values = list(dict.fromkeys(values))
    needed = {"part"} | {dim for name in values for dim in VALUES[name][0]}

    def joined(rows: DataFrame, dim: str, right: DataFrame) -> DataFrame:
        key, own_key = JOINS[dim]
        return rows.join(right, rows[key] == right[own_key], "left")

    rows = table(spark, sf_dir, "lineitem")
    for dim in sorted(JOINS, key=lambda dim: dim != first):
        if dim in needed and dim not in BELONGS.values():
            right, further = table(spark, sf_dir, dim), BELONGS.get(dim)
            if further in needed:
                right = joined(right, further, table(spark, sf_dir, further))
            rows = joined(rows, dim, right)
    return rows.selectExpr(*[f"{VALUES[name][1]} as {name}" for name in values])


PRICES = derive_prices("(price_cents * 100)", "price_unit", f"(avg_weight * {E4})")

LOT_SQL = {
    "avg_price_e4": "price_cents * 100",
    "price_min_e4": "(price_cents - price_spread) * 100",
    "price_max_e4": "(price_cents + price_spread) * 100",
    "report_date_raw": "date_format(report_date, 'MM/dd/yyyy')",
    "published_date_raw": "date_format(published_date, 'MM/dd/yyyy HH:mm:ss')",
    "report_month": "substring(cast(report_date as string), 1, 7)",
    "report_key": "concat(slug_id, '|', report_date)",
    **PRICES,
}


def _lot_column(name: str) -> Column:
    if name == "is_summary":
        return labels.is_summary(F.col("market_type"))
    if name == "breed_type":
        return labels.breed_type(F.col("animal_class"))
    if name == "buyer_intent":
        return labels.buyer_intent(F.col("commodity"))
    return F.expr(LOT_SQL.get(name, name))


ALL_LOT_COLUMNS = tuple(field.name for field in S.LOTS_SCHEMA.fields)


def star_lots(spark: SparkSession, sf_dir: str, columns: str | None = None) -> DataFrame:
    """Lots, with the space-separated ``columns`` or all of them."""
    wanted = columns.split() if columns else list(ALL_LOT_COLUMNS)
    values = ["section", "animal_class", "price_cents"]
    for name in wanted:
        values += DERIVED.get(name, (name,))
    excluded = ", ".join(f"'{name}'" for name in S.EXCLUDED_CLASSES)
    rows = star_rows(spark, sf_dir, values).filter(
        f"section <> '{S.HEADER_SECTION}' and animal_class not in ({excluded}) and price_cents is not null"
    )
    return rows.select(*[_lot_column(name).alias(name) for name in wanted])


# --- the same rows as report files hold them: text, untidy, spelled three ways ---

def _untidy(name: str) -> str:
    """Text with stray white space, or one of several spellings of nothing."""
    spaced = f"case seq % 3 when 0 then {name} when 1 then concat('  ', {name}, '\\t') else concat({name}, ' \\n') end"
    nothing = "element_at(array('', 'N/A', '   ', null, 'NaN'), cast(1 + seq % 5 as int))"
    return f"coalesce({spaced}, {nothing})"


def _number(name: str, decimals: str = "''") -> str:
    text = f"concat(if(seq % 2 = 0, ' ', ''), {name}, {decimals})"
    return f"coalesce({text}, if(seq % 2 = 0, 'abc', 'N/A'))"


def _money(cents: str) -> str:
    return f"concat({cents} div 100, '.', lpad({cents} % 100, 2, '0'))"


RAW_TEXT = {
    "_section": "section",
    "slug_id": "cast(slug_id as string)",
    "report_date": "case seq % 3 when 0 then date_format(report_date, 'MM/dd/yyyy') "
    "when 1 then date_format(report_date, 'M/d/yyyy') else date_format(report_date, 'yyyy-MM-dd') end",
    "published_date": "date_format(published_date, 'MM/dd/yyyy HH:mm:ss')",
    "avg_price": f"coalesce({_money('price_cents')}, 'N/A')",
    "avg_price_min": _money("(price_cents - price_spread)"),
    "avg_price_max": _money("(price_cents + price_spread)"),
    "avg_weight": _number("avg_weight", "if(seq % 3 = 0, '.0', '')"),
    "avg_weight_min": _number("weight_min"),
    "avg_weight_max": _number("weight_max"),
    "weight_break_low": _number("weight_break_low"),
    "weight_break_high": _number("weight_break_high"),
    "head_count": _number("head_count", "if(seq % 4 = 0, '.9', '')"),
    "receipts": _number("receipts"),
    "receipts_week_ago": _number("receipts_week_ago"),
    "receipts_year_ago": _number("receipts_year_ago"),
    "final_ind": "final_ind",
}

# Canonical name -> spelling in each form of file.
FORMS = {
    "canonical": {},
    "alias": {canonical: alias for alias, canonical in S.ALIASES.items() if canonical in S.RAW_INPUTS},
    "published_alias": {"published_date": "published_Date"},
}


def _raw_texts() -> dict[str, str]:
    """Canonical name -> expression of the text."""
    raw_of = {raw: _untidy(lot) for lot, raw in S.TEXT_COLUMNS.items()}
    return {name: RAW_TEXT.get(name) or raw_of[name] for name in S.RAW_INPUTS}


def star_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw report rows, all text, under canonical names."""
    return star_rows(spark, sf_dir, VALUES, "orders").selectExpr(*[f"{text} as `{name}`" for name, text in _raw_texts().items()])


def star_reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw report rows by form of file, all text, each with its ``id``."""
    rows = star_rows(spark, sf_dir, VALUES, "orders")
    return {
        form: rows.filter(f"slug_id % {len(FORMS)} = {i}").selectExpr(
            *[f"{text} as `{spelling.get(name, name)}`" for name, text in _raw_texts().items()], "id"
        )
        for i, (form, spelling) in enumerate(FORMS.items())
    }
