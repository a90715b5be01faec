"""Lots as callers see them: 39 columns, prices as doubles, dates as ISO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .dates import iso_date, iso_stamp
from .exact import dollars


def public_column(name: str) -> Column:
    if name in S.PRICE_COLUMNS:
        return dollars(F.col(f"{name}_e4")).alias(name)
    if name == "report_date":
        return iso_date(F.col(name)).alias(name)
    if name == "published_date":
        return iso_stamp(F.col(name)).alias(name)
    return F.col(name)


def public_lots(lots: DataFrame, columns=S.LOT_COLUMNS) -> DataFrame:
    """The public view; a publication known by its day only has no time of day."""
    shown = {name: public_column(name) for name in columns}
    if "published_date" in shown and "published_date_raw" in lots.columns:
        day_only = ~F.col("published_date_raw").contains(":")
        day = iso_date(F.col("published_date").cast("date"))
        shown["published_date"] = F.when(day_only, day).otherwise(iso_stamp(F.col("published_date"))).alias(
            "published_date"
        )
    return lots.select(*shown.values())


def nested_lots(lots: DataFrame) -> DataFrame:
    """One struct per topic instead of 39 flat columns."""
    topics = {
        "market": {
            "name": "market_name", "city": "market_city", "state": "market_state",
            "slug_id": "slug_id", "report_title": "report_title", "market_type": "market_type",
        },
        "animal": {
            "species": "species", "commodity": "commodity", "class": "animal_class",
            "breed_type": "breed_type", "quality_grade": "quality_grade",
            "lot_desc": "lot_desc", "dressing": "dressing", "age": "age", "frame": "frame",
            "muscle_grade": "muscle_grade", "yield_grade": "yield_grade",
        },
        "pricing": {
            "price_unit": "price_unit", "avg_price": "avg_price", "price_min": "price_min",
            "price_max": "price_max", "price_per_lb": "price_per_lb",
            "price_per_head": "price_per_head",
        },
        "weight": {
            name: name for name in (
                "avg_weight", "weight_min", "weight_max", "weight_break_low", "weight_break_high",
            )
        },
        "volume": {
            name: name for name in (
                "head_count", "receipts", "receipts_week_ago", "receipts_year_ago",
            )
        },
        "derived": {"buyer_intent": "buyer_intent", "breed_type": "breed_type"},
    }
    structs = [
        F.struct(*[public_column(source).alias(field) for field, source in fields.items()]).alias(topic)
        for topic, fields in topics.items()
    ]
    return lots.select(
        "id", public_column("report_date"), public_column("published_date"), *structs, "narrative"
    )
