"""Cuts by joins against removal of each edge and node, and biconnected sets against paths around each node."""

import itertools
import random

import pytest

from gleaner.operators import cuts
from gleaner.operators import graph as g


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def reached(near, start, without_node=None, without_edge=None):
    seen, todo = set(), [start]
    while todo:
        v = todo.pop()
        if v not in seen and v != without_node:
            seen.add(v)
            todo += [u for u in near[v] if {u, v} != without_edge]
    return seen


def plain_blocks(edges):
    """Edges that meet in v are in one set if their other ends are joined without v."""
    near, head = neighbours(edges), {e: e for e in edges}

    def find(e):
        while head[e] != e:
            head[e] = head[head[e]]
            e = head[e]
        return e

    for v, own in near.items():
        left = set(own)
        while left:
            a = min(left)
            part = reached(near, a, without_node=v) & left
            left -= part
            for b in part:
                head[find((min(v, b), max(v, b)))] = find((min(v, a), max(v, a)))
    out = {}
    for e in edges:
        out.setdefault(find(e), []).append(e)
    return {("%d-%d" % min(own), *e) for own in out.values() for e in own}


def several(rng):
    """Parts of many shapes side by side: random ones, a path, a circle, a star, a complete one, a chain of circles."""
    out = [tuple(rng.sample(range(40), 2)) for _ in range(46)] + [tuple(rng.sample(range(100, 120), 2)) for _ in range(40)]
    out += [(200 + i, 201 + i) for i in range(60)] + [(300 + i, 300 + (i + 1) % 30) for i in range(30)] + [(400, 401 + i) for i in range(80)] + [(401, 402), (403, 404), (404, 405)]
    out += list(itertools.combinations(range(500, 507), 2)) + [(600 + 3 * i + a, 600 + 3 * i + b) for i in range(8) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3))] + [(900, 901)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_of_many_shapes(spark, seed):
    rng = random.Random(seed)
    raw = several(rng)
    edges = sorted({tuple(sorted(e)) for e in raw})
    df = spark.createDataFrame([*raw, *((b, a) for a, b in raw[:20]), (7, 7), (None, 3), (3, None), (5000, 5000)], "src long, dst long").selectExpr("*", "'z' AS id", "'z' AS component", "'z' AS next", "'z' AS n")
    near = neighbours(edges)
    got = {tuple(r) for r in cuts.biconnected(df).collect()}
    assert got == plain_blocks(edges)
    bridges = {tuple(r) for r in cuts.bridges(df).collect()}
    assert bridges == {(a, b) for a, b in edges if b not in reached(near, a, without_edge={a, b})} == {r[1:] for r in got if sum(x[0] == r[0] for x in got) == 1}
    if seed == 1:
        points = {v for v in near if any(u not in reached(near, min(near[v]), without_node=v) for u in near[v])}
        assert {r.id for r in cuts.articulation_points(df).collect()} == points
        sizes = {}
        for block in {r[0] for r in got}:
            n = len({v for r in got if r[0] == block for v in r[1:]})
            if n > 2:
                sizes[n] = sizes.get(n, 0) + 1
        assert {r.nodes: r.blocks for r in cuts.biconnected_sizes(df).collect()} == sizes
        left = g.component_sizes(spark.createDataFrame([e for e in edges if e not in bridges], "src long, dst long")).groupBy("nodes").count()
        assert sorted(map(tuple, cuts.without_bridges(df.select("src", "dst").where("src < dst").union(df.select("dst", "src").where("src > dst")).distinct()).collect())) == sorted(map(tuple, left.collect()))


def test_forest_and_tour(spark):
    edges = sorted({tuple(sorted(e)) for e in several(random.Random(3))})
    forest = cuts.spanning_forest(spark.createDataFrame(edges, "src long, dst long"))
    own = [tuple(r) for r in forest.collect()]
    near, all_near = neighbours(own), neighbours(edges)
    assert set(own) <= set(edges) and len(own) == len(set(own))
    parts = {frozenset(reached(all_near, v)) for v in all_near}
    assert {frozenset(reached(near, v)) for v in all_near} == parts and len(own) == len(all_near) - len(parts)
    tour = {r.id: r for r in cuts.euler_tour(forest).collect()}
    assert tour.keys() == all_near.keys()
    for part in parts:
        assert {tour[v].component for v in part} == {min(part)}
        for v in part:
            inside = {u for u in part if tour[v].first <= tour[u].first <= tour[v].last}
            assert inside == (part if v == min(part) else reached(near, v, without_node=tour[v].parent))


def test_no_edges(spark):
    none = spark.createDataFrame([(4, 4)], "src long, dst long")
    for cut in (cuts.bridges, cuts.biconnected, cuts.articulation_points, cuts.biconnected_sizes, cuts.without_bridges):
        assert cut(none).count() == 0


def test_a_hub_and_a_long_path(spark):
    """No component is one task's work, and rounds hang on the logarithm of its size."""
    hub = [(0, i) for i in range(1, 3001)] + [(3000 + i, 3001 + i) for i in range(1500)] + [(1, 2)]
    df = spark.createDataFrame(hub, "src long, dst long")
    assert {tuple(r) for r in cuts.bridges(df).collect()} == set(hub) - {(0, 1), (0, 2), (1, 2)}
