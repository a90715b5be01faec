from paddock import schema as S


def raw_row(**given):
    """A complete, valid raw report row as text; ``given`` replaces or adds columns."""
    row = {
        "_section": "Report Details", "slug_id": "1772", "report_date": "02/09/2026",
        "published_date": "02/09/2026 18:47:05", "market_location_name": "Public Auction Yards",
        "market_location_city": "Billings", "market_location_state": "MT",
        "report_title": "Sheep & Goat Auction", "market_type_category": "Auction",
        "category": "Sheep", "commodity": "Slaughter Sheep/Lambs", "class": "Wooled & Shorn",
        "price_unit": "Per Cwt", "avg_price": "264.58", "avg_price_min": "255.0",
        "avg_price_max": "275", "avg_weight": "118", "head_count": "4", "receipts": "343",
        "receipts_week_ago": "1301", "final_ind": "Final",
    }
    row.update(given)
    return {name: value for name, value in row.items() if value != "absent"}


def raw_frame(spark, *rows, **columns):
    """A text frame of rows that share their columns, each with an ``id``."""
    names = list(rows[0])
    data = [tuple(row[name] for name in names) + (str(i),) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"`{name}` string" for name in [*names, "id"]))


LOT = {name: None for name in S.LOTS_SCHEMA.fieldNames()}


def lot_frame(spark, *rows):
    """Lots with the given columns, the rest as in an ordinary auction lot or null."""
    import datetime

    base = {
        **LOT, "species": "Goats", "commodity": "Slaughter Goats", "animal_class": "Kids",
        "buyer_intent": "meat", "is_summary": False, "market_name": "M", "market_state": "TX",
        "report_date": datetime.date(2026, 2, 9), "report_month": "2026-02",
        "avg_price_e4": 2_000_000, "price_per_lb_e4": 20_000, "avg_weight": 60, "head_count": 1,
        "price_unit": "Per Cwt", "slug_id": 1, "final_ind": "Final",
    }
    data = []
    for i, row in enumerate(rows):
        full = {**base, "id": f"{i:04d}", **row}
        if "report_date" in row:
            day = row["report_date"]
            day = datetime.date.fromisoformat(day) if day else None
            full["report_date"] = day
            full["report_month"] = f"{day:%Y-%m}" if day else None
        data.append(tuple(full[name] for name in S.LOTS_SCHEMA.fieldNames()))
    return spark.createDataFrame(data, S.LOTS_SCHEMA)
