"""Cuts, flows, groups, timed and typed networks, the result store."""


import pandas as pd
import pytest

from gleaner.crawl import store
from gleaner.operators import graph as g
from gleaner.operators import networks as nw

T7 = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (6, 7)]


@pytest.fixture(scope="module")
def t7(spark):
    return spark.createDataFrame(T7, "src long, dst long")


def split(edges):
    nodes = {v for e in edges for v in e}
    left, parts = set(nodes), 0
    while left:
        parts += 1
        todo = [left.pop()]
        while todo:
            v = todo.pop()
            for a, b in edges:
                for u in ((b,) if a == v else (a,) if b == v else ()):
                    if u in left:
                        left.discard(u)
                        todo.append(u)
    return parts


def test_max_flow():
    arcs = pd.DataFrame([(0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4)], columns=["src", "dst", "capacity"])
    assert nw.max_flow(arcs, 0, 3) == 5.0 and nw.max_flow(arcs, 3, 0) == 0.0


def test_groups(spark, t7):
    group = spark.createDataFrame([(5,)], "id long")
    assert nw.group_degree_centrality(t7, group).first()[0] == pytest.approx(3 / 6)
    assert nw.group_closeness(t7, group).first()[0] == pytest.approx(6 / 9)
    assert {r["id"]: r["paths"] for r in nw.two_paths(t7).collect()}[5] == 3
    assert {r["triangles"]: r["nodes"] for r in nw.triad_participation(t7).collect()} == {0: 4, 1: 3}


def test_weighted_and_personal_ranks(spark, t7):
    arcs = g.both_ways(t7).selectExpr("src", "dst", "1.0 as weight")
    even = {r["id"]: r["rank"] for r in nw.weighted_page_rank(arcs, g.nodes_of(t7), rounds=5).collect()}
    plain = {r["id"]: r["rank"] for r in g.page_rank(g.both_ways(t7), g.nodes_of(t7), rounds=5, exact_rounds=True).collect()}
    assert even == pytest.approx(plain)
    own = {r["id"]: r["rank"] for r in nw.weighted_page_rank(arcs, g.nodes_of(t7), spark.createDataFrame([(7,)], "id long")).collect()}
    assert own[7] > own[1] and sum(own.values()) == pytest.approx(1.0)


def test_singular_values(spark):
    """A star of n leaves has the singular value sqrt(n) twice."""
    got = [r["value"] for r in nw.singular_values(g.star(spark, 10), 1, rounds=21).collect()]
    assert got[0] == pytest.approx(3.0, rel=0.3)


def test_timed(spark):
    e = spark.createDataFrame([(1, 2, "2024-01-01"), (2, 1, "2024-01-02"), (2, 3, "2024-01-02")], "src long, dst long, t string").selectExpr("src", "dst", "cast(t as timestamp) as ts")
    assert [r["edges"] for r in nw.time_buckets(e, cumulative=True).orderBy("bucket").collect()] == [1, 3]
    assert [(r["nodes"], r["edges"]) for r in nw.growth(e).orderBy("bucket").collect()] == [(2, 1), (1, 1)]
    assert nw.up_to(e, "2024-01-01").count() == 1


def test_typed(spark, t7):
    nodes, edges = nw.typed_network({"a": g.nodes_of(t7), "b": spark.range(2)}, {("a", "a"): t7, ("a", "b"): t7.limit(2)})
    assert nodes.count() == 9 and edges.count() == 10 and nw.typed_subgraph(edges, ["a"]).count() == 8


def test_benchmark_graph():
    edges, owner = nw.community_benchmark(400, 8, 30, 0.2, (20, 60), 3)
    c = dict(zip(owner.id, owner.community))
    out = sum(c[a] != c[b] for a, b in edges.itertuples(index=False)) / len(edges)
    assert 0.1 < out < 0.35 and not edges.duplicated().any()
    assert owner.community.value_counts().between(20, 80).all()


def test_store_runs_only_what_is_missing(spark, t7, tmp_path):
    labels = spark.createDataFrame([(i, int(i in (3, 5, 6))) for i in range(1, 8)], "id long, y int")
    path = str(tmp_path / "results")
    first = store.run_missing(spark, "t7", t7, labels, ["bfs"], 2, 7, path)
    assert first.select("instance").distinct().count() == 2
    more = store.run_missing(spark, "t7", t7, labels, ["bfs", "mod"], 3, 7, path)
    got = {(r["crawler"], r["instance"]): r["n"] for r in more.groupBy("crawler", "instance").count().withColumnRenamed("count", "n").collect()}
    assert sorted(got) == [("bfs", 0), ("bfs", 1), ("bfs", 2), ("mod", 0), ("mod", 1), ("mod", 2)] and set(got.values()) == {8}
    assert more.where("step = 7 and value = 1.0").count() == 6


def test_core_periphery(spark):
    assert nw.core_periphery(g.complete(spark, 5)).first()["core_size"] >= 4
