import random

import pytest

from lumenlog.llm import common


def test_components_of_hubs_and_chains(spark):
    rng = random.Random(3)
    links = [(5, k) for k in range(1000, 1900)] + [(k, k + 1) for k in range(100, 140)] + [(rng.randint(2000, 2600), rng.randint(2000, 2600)) for _ in range(400)]
    links += [(1899, 120), (7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent}
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in common.connected_components(frame).collect()} == want
    assert common.connected_components(frame.limit(0)).count() == 0


def test_the_links_of_a_hub_are_spread(spark):
    links = spark.range(10_000).selectExpr("1L as u", "id + 2 as v")
    least = spark.createDataFrame([(1, 1, 10_000)], "u long, m long, n long")
    out = common.spread_join(links, least, 20_000)
    assert out.count() == 10_000 and out.where("m = 1").count() == 10_000
    assert "salt" in out._jdf.queryExecution().executedPlan().toString()


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        common.shared_dir(Session())
