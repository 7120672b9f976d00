import pytest

from lodestore.plans import queries
from lodestore.plans.queries import ORACLE, QUERIES

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), ORACLE[name], con) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plan_of_a_search_has_no_shuffle(spark, sf):
    text = QUERIES["knn_xor"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_postfilter_stays_above_the_limit(spark, sf):
    text = QUERIES["knn_postfilter"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("try_variant_get") < text.rindex("GlobalLimit")


def test_csv_files_have_a_bound(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "CSV_ROWS", 20)
    df = QUERIES["csv_rows"](spark, sf)
    assert len(df.inputFiles()) >= df.count() / 20 > 5
