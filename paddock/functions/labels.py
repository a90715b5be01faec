"""Small lookups, written as expressions so that no join is needed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S
from .exact import round_half_up


def lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def breed_type(animal_class: Column) -> Column:
    return (
        F.when(animal_class.isin(*S.HAIR_CLASSES), "Hair")
        .when(animal_class.isin(*S.WOOLED_CLASSES), "Wooled")
    )


def buyer_intent(commodity: Column) -> Column:
    return lookup(commodity, S.INTENT_BY_COMMODITY)


def intent_label(intent: Column) -> Column:
    return F.coalesce(lookup(intent, S.LABEL_BY_INTENT), F.lit(S.OTHER_INTENT_LABEL))


def is_summary(category: Column, slug: Column | None = None, summary_slugs=()) -> Column:
    """Weekly summaries by category, and by report id where ids are given."""
    flag = category.eqNullSafe(S.SUMMARY_CATEGORY)
    if slug is not None and summary_slugs:
        flag = flag | F.coalesce(slug.isin(*summary_slugs), F.lit(False))
    return flag


def commodity_series(commodity: Column) -> Column:
    """The chart series a commodity is drawn in; null if it is drawn nowhere."""
    out = F.lit(None).cast("string")
    for name in ("Replacement", "Feeder", "Slaughter"):
        out = F.when(commodity.contains(name), name).otherwise(out)
    return out


def commodity_short(commodity: Column) -> Column:
    shorter = F.replace(commodity, F.lit("Sheep/Lambs"), F.lit("S/L"))
    return F.replace(shorter, F.lit("Goats"), F.lit("G"))


def receipts_change_pct(receipts: Column, week_ago: Column) -> Column:
    """Whole per cent against the week before; null if either is null or zero."""
    base = F.nullif(week_ago, F.lit(0))
    known = receipts.isNotNull() & (receipts != 0) & base.isNotNull()
    return F.when(known, round_half_up((receipts - base) / base * 100).cast("bigint"))


def outlier_flag(price_per_lb_e4: Column) -> Column:
    out_of_range = (price_per_lb_e4 < S.OUTLIER_LOW_E4) | (price_per_lb_e4 > S.OUTLIER_HIGH_E4)
    return F.coalesce(out_of_range, F.lit(False))
