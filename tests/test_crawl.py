"""The crawl kernel: hand-worked orders, invariants, and increments against closed forms."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.crawl import run as crawl
from gleaner.crawl.policies import POLICIES
from gleaner.crawl.state import Crawl, Csr
from gleaner.operators import features as ft

EDGES = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (6, 7)]
TARGETS = {3, 5, 6}


def toy():
    return Csr.build(np.array([a for a, _ in EDGES]), np.array([b for _, b in EDGES]), {i: int(i in TARGETS) for i in range(1, 8)})


@pytest.mark.parametrize(
    "name,order",
    [("bfs", "1 2 3 4 5 6 7"), ("dfs", "1 3 5 6 7 4 2"), ("mod", "1 3 2 5 4 6 7"), ("mrd", "1 3 5 2 6 4 7"), ("med", "1 3 5 2 6 4 7")],
)
def test_hand_worked_orders(name, order):
    assert crawl.crawl_once(toy(), crawl.PRESETS[name], 1, 7, 0)["node"].tolist() == [int(x) for x in order.split()]


def random_graph(seed, n=30, m=60):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, n, (m, 2))
    return Csr.build(pairs[:, 0], pairs[:, 1], {i: int(rng.random() < 0.3) for i in range(n)})


@pytest.mark.parametrize("name", sorted(crawl.PRESETS))
def test_runs_are_whole_and_repeatable(name):
    g = random_graph(3)
    seed = int(g.ids[0])
    log = crawl.crawl_once(g, crawl.PRESETS[name], seed, 100, 5)
    assert log["node"].is_unique and log["step"].tolist() == list(range(1, len(log) + 1))
    reach, todo = {0}, [0]
    while todo:
        for u in g.near(todo.pop()).tolist():
            if u not in reach:
                reach.add(u)
                todo.append(u)
    assert len(log) == len(reach)  # all that can be reached, and no more
    again = crawl.crawl_once(g, crawl.PRESETS[name], seed, 10, 5)
    assert again["node"].tolist() == log["node"].tolist()[:10]  # a smaller budget is a prefix


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_invariants(seed):
    g = random_graph(seed)
    state = Crawl(g)
    policy = POLICIES["random"](state, np.random.default_rng(seed))
    v = 0
    while v is not None:
        policy.after(v, state.crawl(v))
        assert not any(state.crawled[u] for u in state.observed)
        for u in state.observed:
            assert state.crawled[g.near(u)].any()
        v = policy.next()


def test_increments_equal_closed_forms(spark):
    g = random_graph(11)
    src, dst = np.repeat(np.arange(len(g.ids)), np.diff(g.indptr)), g.indices
    edges = spark.createDataFrame(pd.DataFrame({"src": g.ids[src], "dst": g.ids[dst]}).query("src < dst"))
    labels = spark.createDataFrame(pd.DataFrame({"id": g.ids, "y": g.y.astype(int)}))
    state = Crawl(g)
    for v in (0, 3, 7, 9, 12):
        state.crawl(v)
    crawled = spark.createDataFrame([(int(g.ids[v]),) for v in state.order], "id long")
    for r in ft.node_features(edges, crawled, labels).collect():
        v = int(np.searchsorted(g.ids, r["id"]))
        assert state.own_features(v) == pytest.approx([r["od"], r["cc"], r["cnf"], r["tnf"]])
        assert state.features(v)[4:7] == pytest.approx([r["tri2"], r["tri1"], r["tri0"]])


def test_declarations_round_trip():
    d = crawl.Declaration("mod", {"batch": 3, "x": {"b": 2, "a": [1, None, True]}})
    assert crawl.Declaration.from_json(d.to_json()) == d
    assert d.key == crawl.Declaration("mod", {"x": {"a": [1, None, True], "b": 2}, "batch": 3}).key


def test_seed_must_exist():
    with pytest.raises(ValueError):
        crawl.crawl_once(toy(), crawl.PRESETS["bfs"], 99, 3, 0)


def test_large_graphs_are_refused(spark):
    with pytest.raises(ValueError):
        crawl.collect_graph(spark.createDataFrame(EDGES, "src long, dst long"), max_edges=3)


def test_learned_policies_find_targets():
    """On a graph where targets cling together, a learned crawler beats a random one."""
    rng = np.random.default_rng(5)
    n = 200
    y = {i: int(i < 50) for i in range(n)}
    pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < (0.12 if y[a] == y[b] == 1 else 0.02)]
    g = Csr.build(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), y)
    hits = lambda name: np.mean([crawl.crawl_once(g, crawl.PRESETS[name], int(g.ids[0]), 60, s)["y"].sum() for s in range(4)])
    base = hits("random")
    for name in ("mtn", "average", "exponential", "knn"):
        assert hits(name) > base
