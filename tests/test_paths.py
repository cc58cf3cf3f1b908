import random

import pytest

from linkweave.operators.graph import LinkGraph
from linkweave.operators.paths import all_shortest_paths


def brute(nodes, links, start, goal):
    if start not in nodes or goal not in nodes:
        return set()
    level = {(start,)}
    seen = {start}
    while level:
        done = {p for p in level if p[-1] == goal}
        if done:
            return done
        level = {(*p, d) for p in level for s, d in links if s == p[-1] and d not in seen}
        seen |= {p[-1] for p in level}
    return set()


@pytest.mark.parametrize("seed", range(3))
def test_random_multigraphs(spark, seed):
    r = random.Random(seed)
    nodes = list(range(0, 36, 2))
    links = [(r.choice(nodes), r.choice(nodes)) for _ in range(34)]
    links += r.sample(links, 6) + [(nodes[0], nodes[0])]
    graph = LinkGraph(spark.createDataFrame([(n,) for n in nodes], "page_id long"), spark.createDataFrame(links, "src long, dst long"))
    for start, goal in ((r.choice(nodes), r.choice(nodes)), (nodes[0], nodes[-1]), (nodes[1], nodes[1]), (1, 1), (nodes[0], 99)):
        got = [tuple(x.path) for x in all_shortest_paths(graph, start, goal).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(nodes, links, start, goal)


def test_graph_invariants(spark, tmp_path):
    r = random.Random(8)
    nodes = sorted(r.sample(range(10_000), 300))
    links = [(r.choice(nodes), r.choice(nodes)) for _ in range(900)]
    graph = LinkGraph(spark.createDataFrame([(n,) for n in nodes], "page_id long"), spark.createDataFrame(links, "src long, dst long"))
    assert [tuple(x) for x in graph.vertex_index().orderBy("idx").collect()] == [(n, k) for k, n in enumerate(nodes)]
    for reverse in (False, True):
        off = [x.off for x in graph.offsets(reverse).orderBy("idx").collect()]
        assert off == sorted(off) and off[-1] == 900 and len(off) == 301
        assert sum(x.degree for x in graph.degrees_from_offsets(reverse).collect()) == 900
    stats = graph.stats().first()
    assert stats.vertices == 300 and stats.edges_len == stats.last_offset == stats.last_reverse_offset == 900
    graph.save(f"{tmp_path}/g")
    again = LinkGraph.load(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, again.links.collect())) == sorted(links) and again.nodes.count() == 300
    again.nodes.withColumnRenamed("page_id", "x").write.parquet(f"{tmp_path}/h/nodes")
    again.links.write.parquet(f"{tmp_path}/h/links")
    with pytest.raises(ValueError, match="link graph"):
        LinkGraph.load(spark, f"{tmp_path}/h")


def test_empty_graph(spark):
    graph = LinkGraph(spark.createDataFrame([], "page_id long"), spark.createDataFrame([], "src long, dst long"))
    assert graph.vertex_index().collect() == [] and [tuple(x) for x in graph.offsets().collect()] == [(0, 0)]
    assert all_shortest_paths(graph, 1, 2).collect() == []
