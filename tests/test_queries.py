"""Every registered query against its expected SQL, on the smallest tables."""

import __spark_entry__ as app
import check
import pytest

# The smallest tables hold one key twice; keyed writes keep one of the two rows.
KEYED = {"upsert_lots", "upsert_corrected_date"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(app.queries()) - KEYED))
def test_equals_expected(spark, duck, sf_dir, name):
    # On tables this small some narrow reports are empty; check.py on larger ones
    # asks for rows.
    assert check.compare(spark, duck, sf_dir, name) in ("", "equal, but no rows")


@pytest.mark.parametrize("name", sorted(KEYED))
def test_keyed_write_keeps_one_row_per_key(spark, duck, sf_dir, name):
    got = app.queries()[name](spark, sf_dir).select("id").toPandas()["id"].tolist()
    want = [row[0] for row in duck.execute(app.oracle_sql()[name]).fetchall()]
    assert len(want) == len(set(want)) + 1
    assert sorted(got) == sorted(set(want))


def test_entry(spark):
    frame = app.entry(spark)
    assert frame.columns[0] == "week_label" and frame.count() > 0


def test_every_expected_sql_has_a_query():
    assert set(app.oracle_sql()) <= set(app.queries())
