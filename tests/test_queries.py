"""Every registered query of the reference operators against its SQL twin, or for rows where SQL has none."""

from __future__ import annotations

import pytest

from siltstone.plans import catalog
from tests.oracle import DATA, assert_same

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), SF, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    (row,) = e.entry(spark).collect()
    assert row.mrr == 1.0 and row.query_count == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_dense_ann(spark, sf):
    """Nine tenths of the exact neighbours, from less than a fifth of the pairs."""
    from siltstone.operators import search
    from siltstone.plans.search import _queries, table

    exact, near = (catalog.queries()[name](spark, f"{DATA}/{sf}").select("query_id", "vec_id") for name in ("dense_topk", "dense_ann"))
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * exact.count() > 0
    v = table(spark, f"{DATA}/{sf}", "embeddings")
    pairs = search.ann_pairs(v, _queries(v), "vec_id", "embedding", "query_id", "query_vector")
    assert pairs.count() <= 0.2 * v.count() * _queries(v).count()
