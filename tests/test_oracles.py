"""Every query with SQL must agree with it value by value on the smallest tables."""

import pytest
from oracle import differences

from foldwise.plans.oracles import ORACLES
from foldwise.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
# Among the 18 chats of the smallest tables labels of one or two chats are no density clusters of their own
# (the brute-force HDBSCAN agrees), so the SQL, which takes the labels as given, applies from sf0.01 on.
FROM_NEXT_SIZE = {"move_plan"}


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"plan_document", "hdbscan_clusters", "kmeans_fallback"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    sf_dir = SMALL if name not in FROM_NEXT_SIZE else "/root/testdata/sf0.01"
    assert differences(spark, sf_dir, name, QUERIES, ORACLES) == ""


def test_rows_only_queries(spark):
    lines = QUERIES["plan_document"](spark, SMALL).orderBy("section", "place", "item").collect()
    assert lines[0].text.startswith("{") and lines[-1].text.endswith("}")
    labels = QUERIES["hdbscan_clusters"](spark, SMALL).groupBy("cluster_id").count().collect()
    assert all(r["count"] >= 2 for r in labels if r.cluster_id >= 0) and sum(r["count"] for r in labels) == 500
    groups = QUERIES["kmeans_fallback"](spark, SMALL).collect()
    assert sum(r.n for r in groups) == 500 and len(groups) <= 22
