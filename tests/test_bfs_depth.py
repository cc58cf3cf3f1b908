from types import SimpleNamespace

from linkweave.fixture_queries import _levels
from linkweave.operators.graph import LinkGraph


def test_levels_go_on_until_nothing_new_is_found(spark):
    graph = LinkGraph(spark.createDataFrame([(n,) for n in range(29)], "page_id long"), spark.createDataFrame([(n, n + 1) for n in range(28)] + [(28, 0)], "src long, dst long"))
    levels, parents = _levels(SimpleNamespace(kept=lambda: graph, spark=spark), 0)
    assert sorted(map(tuple, levels.collect())) == [(n, n) for n in range(29)]
    assert sorted((r.child, r.parent) for r in parents.collect()) == [(n + 1, n) for n in range(28)]
