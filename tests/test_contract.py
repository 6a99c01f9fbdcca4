"""Driver contract: entry, queries and oracle keys."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert 0 < len(out) <= 20
    assert df.columns == ["ticker", "date", "return_21d", "return_21d_rank"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_query_count():
    assert len(E.queries()) >= 80
