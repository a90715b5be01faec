"""From raw report rows, all text, to typed lots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import labels
from ..functions.dates import parse_date, parse_stamp, report_month
from ..functions.prices import derive_prices
from ..functions.text import clean_string, coerce_numeric, null_tokens, strip, to_int_trunc, to_units_e4
from .filters import date_window

LINEAGE = ("id", "source_file", "source_row", "ingest_seq", "fetch")
PRICE_INPUTS = {
    "avg_price_e4": "avg_price", "price_min_e4": "avg_price_min", "price_max_e4": "avg_price_max",
}


def canonical_name(name: str) -> str:
    return S.ALIASES.get(name, name)


def alias_sources(names: Sequence[str]) -> dict[str, list[int]]:
    """Canonical names and the places that fill them, the canonical spelling first."""
    sources: dict[str, list[int]] = {}
    for i, name in sorted(enumerate(names), key=lambda item: item[1] in S.ALIASES):
        sources.setdefault(canonical_name(name), []).append(i)
    return sources


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Give every column its canonical name.

    Where a frame holds both spellings the canonical one wins and the other fills
    its nulls.  Columns are addressed by position, since some spellings differ only
    in case.
    """
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).selectExpr(
        *[f"coalesce({', '.join(f'c{i}' for i in found)}) as `{name}`" for name, found in alias_sources(df.columns).items()]
    )


def union_reports(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames of different spellings and column sets."""
    out = resolve_aliases(frames[0])
    for frame in frames[1:]:
        out = out.unionByName(resolve_aliases(frame), allowMissingColumns=True)
    return out


def tidy_rows(raw: DataFrame) -> DataFrame:
    """Exactly the columns a lot reads: stripped text, and numbers as ``n_<column>``.

    Absent columns and spellings of a missing value are null.
    """
    present = set(raw.columns)
    numbers = [*PRICE_INPUTS.values(), *S.INTEGER_COLUMNS.values()]
    texts = [name for name in S.RAW_INPUTS if name not in numbers]

    def value(name: str) -> str:
        return f"`{name}`" if name in present else "cast(null as string)"

    def text(name: str) -> str:
        known = null_tokens(value(name))
        return known if name == "_section" else strip(known)

    return raw.selectExpr(
        *[f"{text(name)} as `{name}`" for name in texts],
        *[f"{coerce_numeric(value(name))} as n_{name}" for name in numbers],
        *([f"{strip(value('slug_id'))} as slug_id"] if "id" not in present else []),
        *[name for name in LINEAGE if name in present],
    )


def not_a_lot() -> Column:
    """Why a tidy row is no lot; null for lots."""
    return (
        F.when(F.col("_section").eqNullSafe(S.HEADER_SECTION), "report header")
        .when(F.col("class").isin(*S.EXCLUDED_CLASSES), "excluded class")
        .when(~F.coalesce(F.abs("n_avg_price") < float("inf"), F.lit(False)), "no price")
    )


def drop_non_lots(rows: DataFrame) -> DataFrame:
    return rows.filter(not_a_lot().isNull())


def dropped_rows(raw: DataFrame) -> DataFrame:
    """Rows that are no lots, counted by reason."""
    return (
        tidy_rows(raw)
        .select(not_a_lot().alias("reason"))
        .filter("reason is not null")
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
    )


def lot_id() -> Column:
    """Report id, report date and the row's place in its file, of four digits or more."""
    return F.concat(
        F.coalesce(F.col("slug_id"), F.lit("nan")),
        F.lit("-"),
        F.replace(F.coalesce(F.col("report_date"), F.lit("nan")), F.lit("/"), F.lit("-")),
        F.format_string("-%04d", F.col("source_row")),
    )


def report_key(slug: str, slug_text: str, fetch: str, day: str, day_text: str) -> str:
    """SQL of what tells reports apart: report id and date.

    An id that is no number and a date that does not parse count as their text; a row
    without an id belongs to its fetch, so that such fetches never replace each other.
    """
    report = f"coalesce(cast({slug} as string), nullif({slug_text}, ''), concat('in ', {fetch}))"
    return f"concat({report}, '|', coalesce(cast({day} as string), {day_text}, ''))"


def project_lots(rows: DataFrame, summary_slugs: Sequence[int] = ()) -> DataFrame:
    """Typed lots from tidy rows that have an ``id``.

    Numbers are scaled in a step of their own, so that the prices derived from them
    refer to finished columns.
    """
    integers = {lot: f"n_{raw}" for lot, raw in S.INTEGER_COLUMNS.items()}
    texts = {lot: raw for lot, raw in S.TEXT_COLUMNS.items()}
    scaled = rows.selectExpr(
        "id",
        "report_date as report_date_raw",
        "published_date as published_date_raw",
        *[f"nullif(`{raw}`, '') as {lot}" for lot, raw in texts.items()],
        *[f"{to_int_trunc(number)} as {lot}" for lot, number in integers.items()],
        *[f"{to_units_e4(f'n_{raw}')} as {lot}" for lot, raw in PRICE_INPUTS.items()],
        f"{to_units_e4('n_avg_weight')} as weight_e4",
        "slug_id as slug_text" if "slug_id" in rows.columns else "cast(null as string) as slug_text",
        "fetch" if "fetch" in rows.columns else "cast(null as string) as fetch",
        *[name for name in ("ingest_seq",) if name in rows.columns],
    )
    prices = derive_prices("avg_price_e4", "price_unit", "weight_e4")
    typed = scaled.withColumns(
        {
            **{name: F.expr(price) for name, price in prices.items()},
            "report_date": F.expr(parse_date("report_date_raw")),
            "published_date": F.expr(parse_stamp("published_date_raw")),
            "is_summary": labels.is_summary(F.col("market_type"), F.col("slug_id"), summary_slugs),
            "breed_type": labels.breed_type(F.col("animal_class")),
            "buyer_intent": labels.buyer_intent(F.col("commodity")),
        }
    )
    lots = typed.withColumns(
        {
            "report_month": report_month(F.col("report_date")),
            "report_key": F.expr(report_key("slug_id", "slug_text", "fetch", "report_date", "report_date_raw")),
        }
    )
    return lots.select(
        *S.LOTS_SCHEMA.fieldNames(), *[name for name in ("ingest_seq",) if name in rows.columns]
    )


def normalise(raw: DataFrame, summary_slugs: Sequence[int] = ()) -> DataFrame:
    """Raw report rows to lots.

    The raw frame needs an ``id``, or a ``source_row`` to make the positional id
    from.  One narrow pass: no shuffle, no Python.
    """
    rows = drop_non_lots(tidy_rows(raw))
    if "id" not in raw.columns:
        rows = rows.withColumn("id", lot_id())
    return project_lots(rows, summary_slugs)


def keep_final(lots: DataFrame) -> DataFrame:
    """Without the preliminary rows of reports that also have final ones.

    A narrow list says which reports have final rows; the lots are read once more, and
    only they and that list meet.
    """
    is_final = F.col("final_ind").eqNullSafe("Final")
    final = lots.groupBy(F.col("slug_id").alias("f_slug"), F.col("report_date").alias("f_date")).agg(
        F.max(is_final).alias("has_final")
    )
    # A report without id or date is compared with none.
    same = (F.col("slug_id") == F.col("f_slug")) & (F.col("report_date") == F.col("f_date")) & ~is_final
    return lots.join(final.where("has_final"), same, "left_anti")


def retention(lots: DataFrame, as_of: str, days: int = S.FETCH_DAYS) -> DataFrame:
    """The rolling active set of the last ``days`` days."""
    return date_window(lots, as_of, days)
