"""Every registered query of the library itself: equal to its oracle SQL, or at least runs."""

from __future__ import annotations

import pytest
from oracle import DATA, by_duckdb, rows

from ionlake import registry

#: Answers that may be empty on the smallest tables.
MAY_BE_EMPTY = {"b12_keyword_filter", "d7_page", "i11_welch_t_test", "i11_welch_statistic"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    found = registry.queries()[name](spark, DATA).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(found)
        return
    wanted = by_duckdb(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
    assert len(found) or name in MAY_BE_EMPTY


def test_means_halfway_on_the_larger_tables(spark):
    # A mean of exactly 19.5 is there, whose rounding must not depend on the order of the rows.
    larger = "/root/testdata/sf0.01"
    found = registry.queries()["g5_peak_properties"](spark, larger).toPandas()
    assert rows(found) == rows(by_duckdb(registry.oracle_sql()["g5_peak_properties"], larger))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
