"""Landed report payloads: nested JSON with keys that differ between reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.dates import parse_date
from ..functions.text import strip
from ..operators.filters import days_before

# Every known column under its canonical name.
CANONICAL_COLUMNS = tuple(dict.fromkeys(S.ALIASES.get(name, name) for name in S.KNOWN_RAW_COLUMNS))
SECTIONS = "array<struct<reportSection: string, results: array<map<string, string>>>>"


def scan_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One payload per line, or per file where payloads are written over several lines."""
    return spark.read.text(path, wholetext=whole_files)


def _sections() -> Column:
    text = F.trim("value")
    as_list = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.from_json(as_list, SECTIONS)


def unreadable_payloads(payloads: DataFrame) -> DataFrame:
    """``payloads, unreadable``: how many there are and how many are not whole JSON.

    A blank line is no payload.  Compare before trusting what ``flatten_sections`` gives:
    an unreadable payload has no rows there.
    """
    text = F.trim("value")
    rows = payloads.where(F.length(text) > 0)
    # A string payload is how the source says that it has no data.
    broken = F.try_parse_json(text).isNull()
    return rows.agg(F.count("*").alias("payloads"), F.count_if(broken).alias("unreadable"))


def _record_field(name: str) -> Column:
    """A record's value under its canonical or another known spelling."""
    spellings = [name, *[alias for alias, canonical in S.ALIASES.items() if canonical == name]]
    return F.coalesce(*[F.try_element_at("record", F.lit(spelling)) for spelling in spellings])


def flatten_sections(payloads: DataFrame, columns: Sequence[str] = CANONICAL_COLUMNS) -> DataFrame:
    """One row per record, with its section's name and its place in the payload.

    A payload is a list of sections or a single one; a payload that is neither, or a
    section without results, gives no rows.  Records stay maps until the columns
    asked for are picked, so unknown keys need no schema: what is in none of the columns
    is kept in the map ``other_keys``.
    """
    section_rows = F.transform(
        _sections(),
        lambda section: F.transform(
            F.coalesce(section["results"], F.array().cast("array<map<string,string>>")),
            lambda record: F.struct(
                F.coalesce(section["reportSection"], F.lit(S.UNKNOWN_SECTION)).alias("section"),
                record.alias("record"),
            ),
        ),
    )
    rows = payloads.select(F.posexplode(F.flatten(section_rows)).alias("source_row", "row")).select(
        "source_row", F.col("row.section").alias("_section"), F.col("row.record").alias("record")
    )
    fields = [_record_field(name).alias(name) for name in columns if name != "_section"]
    taken = {"_section", *columns, *[alias for alias, name in S.ALIASES.items() if name in columns]}
    others = F.map_filter("record", lambda key, _: ~key.isin(*taken))
    return rows.select("_section", *fields, others.alias("other_keys"), "source_row")


def fetch_window(rows: DataFrame, as_of: str, days: int = S.FETCH_DAYS) -> DataFrame:
    """Rows published in the ``days`` days up to and including ``as_of``."""
    published = F.expr(parse_date(strip("published_date")))
    first = F.lit(days_before(as_of, days)).cast("date")
    return rows.filter(published.between(first, F.lit(as_of).cast("date")))
