"""Every query of the catalogue against its SQL."""

import pytest

from spanloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(name, same_rows):
    same_rows(catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_lists_and_counts_agree(spark, sf_dir):
    from spanloom.plans import lists

    counts = {r["filter"]: r["traces"] for r in lists.filter_counts(spark, sf_dir).collect()}
    for name in ("filter_level", "filter_all_combined", "filter_user"):
        assert catalogue.QUERIES[name](spark, sf_dir).count() == counts[name]
