"""Curves by hand, bandits, counters, metrics, presets, cuts, communities and betweenness against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.crawl import counters, presets
from gleaner.crawl import evaluation as ev
from gleaner.crawl import run as crawl
from gleaner.crawl.policies import POLICIES, Predicted
from gleaner.crawl.state import Crawl, Csr
from gleaner.crawl.training import Boosting, Online
from gleaner.operators import graph as g
from gleaner.operators import networks as nw
from gleaner.sources import files
from gleaner.sources.catalog import GraphCatalog

EDGES = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (6, 7), (7, 8), (8, 6), (9, 10)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(min(e), max(e)) for e in EDGES], "src long, dst long")


def test_areas_by_hand(spark):
    """x = 0 1 2 4, y = 0 1 1 3, and the same curve from step 1 on, whose first value counts in full in the weighted area."""
    rows = [("zero", 0, 0.0), ("zero", 1, 1.0), ("zero", 2, 1.0), ("zero", 4, 3.0), ("one", 1, 1.0), ("one", 2, 1.0), ("one", 4, 3.0), ("high", 0, 2.0), ("high", 4, 2.0), ("single", 3, 5.0)]
    got = {r["c"]: (r["aucc"], r["waucc"], r["tc"]) for r in ev.curve_measures(spark.createDataFrame(rows, "c string, step int, value double"), ["c"]).collect()}
    assert got["zero"] == pytest.approx((1.375, (1 * 0.5 + 0.5 * 1 + 0.5 * 2) / 2, 3.0))
    assert got["one"] == pytest.approx((0.25 * 1 / 2 + 0.25 + 1.0, (1 + 0.5 * 1 + 0.5 * 2) / 2, 3.0))
    assert got["high"] == pytest.approx((2.0, 2.0, 2.0)) and got["single"] == pytest.approx((2.5, 5.0, 5.0))


def crawl_of(labels, policy="predicted", **options):
    a, b = (np.array(x) for x in zip(*EDGES[:10]))
    state = Crawl(Csr.build(a, b, labels))
    return state, POLICIES[policy](state, np.random.default_rng(0), **options)


def test_bandit_update():
    """The parameter at hand gains one below the limit, and is shrunk from it on; the other one never changes."""
    _, p = crawl_of({1: 1}, predictors=[{"kind": "mtn"}, {"kind": "mtn"}], combine="thompson", threshold=6.0)
    p.arm = 1
    p.learn_weights(np.array([0.5, 0.5]), 1)
    assert p.beta.tolist() == [[2, 2], [3, 2]]
    p.learn_weights(np.array([0.5, 0.5]), 0)
    p.learn_weights(np.array([0.5, 0.5]), 1)
    assert p.beta[1].tolist() == pytest.approx([4 * 6 / 7, 3])
    p.learn_weights(np.array([0.5, 0.5]), -1)
    assert p.beta[1].tolist() == pytest.approx([4 * 6 / 7, 3])
    _, plain = crawl_of({1: 1}, predictors=[{"kind": "mtn"}], combine="thompson")
    plain.learn_weights(np.array([0.5]), 0)
    assert plain.beta[0].tolist() == pytest.approx([2, 2])  # the default limit is 2


def test_online_samples():
    """Inputs are those of the moment after the crawl, unlabelled seeds count as 0, and the window grows until both classes are there."""
    state, p = crawl_of({1: 1, 2: 0}, predictors=[{"kind": "logistic"}], train={"window": 2})
    taken = []
    for v in (0, 1, 2, 3):
        state.observe(v)
        state.crawl(v)
        p.after(v, [])
        taken.append(p.models[0].inputs(v).tolist())
    x, y = p.trainer.samples(p.models[0])
    assert y == [0, 0, 0] or y == [1, 0, 0, 0]
    assert isinstance(p.trainer, Online) and [v.tolist() for v in p.trainer.inputs[id(p.models[0])]] == taken
    assert p.trainer.labels == [1, 0, 0, 0]


def test_boosting_samples():
    """A re-crawl gives its share of the steps, half of them targets where there are enough, and never its first node."""
    labels = {i: int(i % 2 == 0) for i in range(1, 9)}
    state, p = crawl_of(labels, predictors=[{"kind": "logistic"}], train={"kind": "boosting", "share": 0.5, "iterations": 40, "samples": 1000})
    for v in range(8):
        state.observe(v)
        state.crawl(v)
    assert isinstance(p, Predicted) and isinstance(p.trainer, Boosting)
    _, y = p.trainer.samples(p.models[0])
    assert 40 * 3 <= len(y) <= 40 * 4 and 0.4 < np.mean(y) < 0.6


def test_counters_and_metrics(spark):
    seen = counters.Counters()
    state, p = crawl_of(None, "bfs")
    seen.watch(p, "next")
    state.observe(0)
    p.after(0, state.crawl(0))
    assert p.next() == 1
    ((name, calls, seconds),) = seen.rows()
    assert name == "BreadthFirst.next" and calls == 1 and seconds >= 0
    log = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "run_id string, step int, node long")
    got = ev.metric_values(log, {"node": lambda x: x.withColumn("value", F.col("node")), "half": lambda x: x.withColumn("value", F.col("step") / 2)}, [2]).collect()
    assert sorted((r["metric"], r["value"]) for r in got) == [("half", 1.0), ("node", 6.0)]
    answers = spark.createDataFrame([("a", 2, 5), ("a", 2, 9)], "run_id string, step int, node long")
    parts = ev.parts_by_step(log, spark.createDataFrame([(5, 6), (6, 5), (6, 7), (7, 6)], "src long, dst long"), spark.createDataFrame([(6, 1), (5, 0), (7, 1)], "id long, y int"), answers)
    assert sorted((r["step"], r["part"], r["size"], r["hits"]) for r in parts.collect()) == [(1, "crawled", 1, 0), (1, "nodes", 2, 1), (1, "observed", 1, 1), (2, "answer", 2, 0), (2, "crawled", 2, 1), (2, "nodes", 3, 2), (2, "observed", 1, 1)]


def test_presets(spark, edges, tmp_path):
    assert len(presets.PRESETS) == len({p.title for p in presets.PRESETS}) == 22 and {p.budget for p in presets.PRESETS} == {100, 700, 1000, 1200, 3000}
    catalog = GraphCatalog(spark, f"file://{tmp_path}/graphs")
    catalog.register(edges, "own", "small")
    catalog.set_attribute(spark.createDataFrame([(1, 3), (4, 3), (5, 2)], "id long, value long").select("id", F.struct("value").alias("value")), "own", "small", attribute="personal")
    own = presets.Preset("small", ("own", "small"), ("personal", "value"), 3, 6)
    got = presets.run_preset(catalog, own, ["bfs", "mod"], 2, f"file://{tmp_path}/results").collect()
    assert {r["crawler"] for r in got} == {"bfs", "mod"} and max(r["value"] for r in got) == 1.0


def test_threads_of_a_crawl_are_replayed(spark, edges):
    """Crawls of the deterministic policies, step by step, by rules written down plainly."""
    near = {}
    for a, b in EDGES[:10]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def replay(kind):
        done, queue, frozen = [], [1], {}
        while queue:
            if kind == "bfs":
                v = queue[0]
            elif kind == "dfs":
                v = queue[-1]
            elif kind == "mod":
                v = max(queue, key=lambda v: (len(near[v] & set(done)), v))
            elif kind == "mrd":
                v = max(queue, key=lambda v: (len(near[v]), v))
            else:
                v = max(queue, key=lambda v: (frozen.get(v, 0), v))
            queue.remove(v)
            done.append(v)
            for u in sorted(near[v] - set(done) - set(queue)):
                queue.append(u)
                frozen[u] = len(near[u]) - 1
        return done

    for kind in ("bfs", "dfs", "mod", "mrd", "med"):
        runs = crawl.plan_runs(spark, {kind: crawl.PRESETS[kind]}, [1], 20)
        log = sorted((r["step"], r["node"]) for r in crawl.crawl(runs, edges).collect())
        assert [v for _, v in log] == replay(kind), kind


def plain_paths(near, s):
    """Shortest paths from s to each node, as lists of nodes."""
    found, edge = {s: [[s]]}, [s]
    while edge:
        nxt = {}
        for v in edge:
            for u in near[v]:
                if u not in found:
                    nxt.setdefault(u, []).extend(p + [u] for p in found[v])
        found |= nxt
        edge = list(nxt)
    return found


def test_edge_betweenness(spark, edges):
    near = {}
    for a, b in EDGES:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = dict.fromkeys(((min(e), max(e)) for e in EDGES), 0.0)
    for s in near:
        for t, paths in plain_paths(near, s).items():
            for p in paths:
                for a, b in itertools.pairwise(p):
                    want[min(a, b), max(a, b)] += 0.5 / len(paths)
    got = {(r["src"], r["dst"]): r["betweenness"] for r in g.edge_betweenness(edges, g.nodes_of(edges), block=4).collect()}
    assert got == pytest.approx(want)


def test_split_communities(spark):
    two = [(a, b) for a, b in itertools.combinations(range(5), 2)] + [(a + 10, b + 10) for a, b in itertools.combinations(range(5), 2)] + [(0, 10)]
    got = {r["id"]: r["community"] for r in nw.split_communities_by_component(spark.createDataFrame(two, "src long, dst long")).collect()}
    assert got == {i: (0 if i < 10 else 10) for e in two for i in e}


def test_generators_keep_their_promises(spark, edges):
    b = g.bipartite(spark, 20, 30, 200, 1).agg(F.min("src"), F.max("src"), F.min("dst"), F.max("dst")).first()
    assert b[0] >= 0 and b[1] < 20 and b[2] >= 20 and b[3] < 50
    assert g.degrees(g.regular(spark, 60, 4, 1)).agg(F.max("degree")).first()[0] == 4
    top = g.degrees(g.power_law(spark, 500, 2.2, 60, 1)).agg(F.max("degree"), F.expr("percentile(degree, 0.5)")).first()
    assert 10 < top[0] <= 60 and top[1] <= 3
    before = sorted(map(tuple, g.degrees(edges).collect()))
    new = g.rewired(edges, 3, 9)
    assert sorted(map(tuple, g.degrees(new).collect())) == before and new.distinct().count() == len(EDGES) and new.where("src >= dst").count() == 0
    grown = g.growth_graph(80, 3, 1, "geometric", 0.6)
    assert len(grown) > 80 and (grown["src"] < grown["dst"]).all()
    assert g.random_subgraph(edges, 4, 1).count() <= 6 and g.random_edge_subgraph(edges, 5, 1).count() == 5 and g.without_loops(g.with_loops(edges)).count() == len(EDGES)


def test_weighted_closeness_and_cover(spark, edges):
    arcs = g.both_ways(edges).withColumn("weight", F.lit(2.0))
    near = {}
    for a, b in EDGES:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    dist = {t: 2.0 * (len(p[0]) - 1) for t, p in plain_paths(near, 1).items()}
    r, far = len(dist) - 1, sum(dist.values()) / (len(dist) - 1)
    got = nw.weighted_closeness(g.weighted_distances(arcs, spark.range(1, 2)), len(near)).first()
    assert (got["farness"], got["closeness"]) == pytest.approx((far, r / (len(near) - 1) / far))
    cover = [(r["rank"], r["id"], r["gain"]) for r in nw.covering_group(edges, 3).collect()]
    assert cover[0] == (1, 2, 4) and cover[1] == (2, 6, 4) and sum(c[2] for c in cover) == len(near)


def test_exports(spark, edges):
    arcs, numbers = files.dense_arcs(edges)
    assert arcs.count() == 2 * len(EDGES) and sorted(r["number"] for r in numbers.collect()) == list(range(10))
    assert list(files.read_column(edges, "dst", ["src", "dst"])) == [b for _, b in sorted((min(e), max(e)) for e in EDGES)]
    networkx = pytest.importorskip("networkx")
    out = files.to_networkx(edges, spark.createDataFrame([(1, "x")], "id long, kind string"))
    assert isinstance(out, networkx.Graph) and out.nodes[1]["kind"] == "x"


def test_strong_components_of_a_chain(spark):
    """A chain of single components with a cycle at its end."""
    arcs = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(40, 38)], "src long, dst long"))
    got = {r["id"]: r["component"] for r in g.strong_components(arcs).collect()}
    assert got == {i: min(i, 38) for i in range(41)}


def test_graph_network_learns():
    """Two classes of neighbourhoods are told apart by the graph network, and two that no single cut tells apart by trees."""
    _, p = crawl_of({1: 1}, predictors=[{"kind": "sage", "hidden": 5, "decay": 0.0}])
    net = p.models[0]
    rng = np.random.default_rng(1)
    x = np.zeros((60, 11, 9))
    y = np.arange(60) % 2
    for i in range(60):
        n = int(rng.integers(1, 9))
        x[i, : n + 1, :8], x[i, : n + 1, 8] = rng.random((n + 1, 8)), 1.0
        x[i, 1 : n + 1, 3] += y[i]  # only the neighbours tell
    x = x.reshape(60, -1)
    net.fit(x, y)
    assert ((net.apply(x) > 0.5) == y).mean() > 0.95
    assert -np.mean(np.log(np.where(y == 1, net.apply(x), 1 - net.apply(x)))) < 0.3

    trees = crawl_of({1: 1}, predictors=[{"kind": "boosted"}, {"kind": "forest", "trees": 20}])[1].models
    x = rng.random((200, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)  # no single cut tells
    for model in trees:
        model.fit(x, y)
        assert ((model.apply((x - model.mean) / model.scale) > 0.5) == y).mean() > 0.85
