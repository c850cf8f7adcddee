"""Multilevel communities: scores against plain sums and SQL, known optima, levels that never fall."""

import itertools
import math
import random

import duckdb
import pytest

from gleaner.operators import communities as cm
from gleaner.operators import graph as g

K = 6
RING = [(K * c + a, K * c + b) for c in range(8) for a, b in itertools.combinations(range(K), 2)] + [(K * c, (K * (c + 1) + 1) % (8 * K)) for c in range(8)]


def plain_modularity(links, label):
    m = sum(w for *_, w in links)
    k = {}
    for a, b, w in links:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inner = sum(w for a, b, w in links if label[a] == label[b]) / m
    return inner - sum((sum(k[v] for v in k if label[v] == c) / (2 * m)) ** 2 for c in set(label.values()))


def plain_code_length(links, label):
    """Shannon's bound for the index of modules, and for each module's nodes and its exit, weighted by how often they are used."""
    s = 2 * sum(w for *_, w in links)
    p, out = {}, {}
    for a, b, w in links:
        for x, y in ((a, b), (b, a)):
            p[x] = p.get(x, 0) + w / s
            if label[x] != label[y]:
                out[label[x]] = out.get(label[x], 0) + w / s

    def entropy(values):
        total = sum(values)
        return -sum(v / total * math.log2(v / total) for v in values if v > 0)

    length = sum(out.values()) * entropy(out.values()) if out else 0.0
    for c in set(label.values()):
        use = [p[v] for v in p if label[v] == c] + [out.get(c, 0.0)]
        length += sum(use) * entropy(use)
    return length


def links_from(edges):
    return [(a, b, 1.0) for a, b in sorted({tuple(sorted(e)) for e in edges if e[0] != e[1]})]


def labels_of(df):
    rows = df.collect()
    out = {r.id: r.community for r in rows}
    assert len(out) == len(rows)
    for c in set(out.values()):
        assert c == min(v for v in out if out[v] == c)
    return out


@pytest.mark.parametrize("score, value", [(cm.MODULARITY, plain_modularity), (cm.MAP_EQUATION, plain_code_length)])
def test_planted_communities_are_found(spark, score, value):
    """Eight complete graphs in a ring, a star by itself, loops, nulls and repeated edges."""
    raw = [*RING, *((b, a) for a, b in RING[:30]), (3, 3), (None, 4), *((100, 101 + i) for i in range(5))]
    labels, levels = cm.multilevel(spark.createDataFrame(raw, "src long, dst long"), score)
    label, links = labels_of(labels), links_from([e for e in raw if None not in e])
    assert label == {v: (100 if v >= 100 else v // K * K) for e in links for v in e[:2]}
    assert [x[2] for x in levels] == sorted(x[2] for x in levels) and levels[-1][1] == 9
    if score is cm.MODULARITY:
        assert levels[-1][2] == pytest.approx(value(links, label))
        assert g.modularity(spark.createDataFrame([x[:2] for x in links], "src long, dst long"), labels).first()[0] == pytest.approx(value(links, label))
    else:
        assert cm.code_length(spark.createDataFrame(raw, "src long, dst long"), labels).first()[0] == pytest.approx(value(links, label))
        alone = {v: v for v in label}
        assert levels[0][2] - levels[-1][2] == pytest.approx(value(links, label) - value(links, alone))


def test_weighted_scores_and_levels(spark):
    """Scores of the levels are those of the labels, by weights; nothing near is better for a single node at the end."""
    rng = random.Random(7)
    edges = [(a, b, float(rng.randint(1, 9)) * (8 if a // 9 == b // 9 else 1)) for a, b in itertools.combinations(range(36), 2) if rng.random() < (0.6 if a // 9 == b // 9 else 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels, levels = cm.multilevel(df, cm.MODULARITY, "weight")
    label = labels_of(labels)
    assert levels[-1][2] == pytest.approx(plain_modularity(edges, label)) and [x[2] for x in levels] == sorted(x[2] for x in levels)
    assert levels[-1][2] >= plain_modularity(edges, {v: v // 9 for v in label}) - 1e-9
    con = duckdb.connect()
    con.execute("CREATE TABLE e (a INT, b INT, w DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", edges)
    con.execute("CREATE TABLE l (id INT, c INT)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(label.items()))
    sql = """WITH m AS (SELECT sum(w) AS m FROM e), k AS (SELECT c, sum(w) AS k FROM (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) JOIN l USING (id) GROUP BY c),
        i AS (SELECT sum(w) AS i FROM e JOIN l x ON x.id = a JOIN l y ON y.id = b WHERE x.c = y.c) SELECT i / m - (SELECT sum(power(k / (2 * m), 2)) FROM k, m) FROM i, m"""
    assert levels[-1][2] == pytest.approx(con.execute(sql).fetchone()[0])


def test_code_length_of_any_labels(spark):
    rng = random.Random(9)
    edges = sorted({tuple(sorted(rng.sample(range(15), 2))) for _ in range(40)})
    label = {v: rng.randrange(4) for e in edges for v in e}
    got = cm.code_length(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(list(label.items()), "id long, community int")).first()[0]
    assert got == pytest.approx(plain_code_length(links_from(edges), label))


def test_contraction_and_no_edges(spark):
    links = spark.createDataFrame([(1, 2, 2.0), (1, 3, 1.0), (2, 3, 4.0), (3, 4, 8.0)], "src long, dst long, w double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, community long")
    assert [tuple(r) for r in cm.contract(links, labels).collect()] == [(1, 3, 5.0)]
    labels, levels = cm.multilevel(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert labels.count() == 0 and levels == [(0, 0, 0.0)]


def test_twins_start_together(spark, monkeypatch):
    """Twins of any degree k, k * k < 2m, are together in the best partition; complete graphs by themselves take no moves."""
    rng = random.Random(3)
    for _ in range(4):
        edges = {e for e in itertools.combinations(range(6), 2) if rng.random() < 0.6} | {(0, 1)}
        near = {v: {v} | {a + b - v for a, b in edges if v in (a, b)} for v in range(6)}
        near = {v: x for v, x in near.items() if len(x) > 1}
        small = {v for v in near if (len(near[v]) - 1) ** 2 < 2 * len(edges)}
        want = {v: min(u for u in near if near[u] == near[v]) if v in small else v for v in near}
        links = links_from(edges)
        got = cm._twins(spark.createDataFrame(links, "src long, dst long, w double"), len(links)).collect()
        assert {r.id: r.community for r in got} == want and all(r.n == list(want.values()).count(r.community) and r.k == len(near[r.id]) - 1 for r in got)
        parts = ({v: c for v, c in zip(near, p, strict=True)} for p in itertools.product(range(len(near)), repeat=len(near)) if all(c <= max(p[:i], default=-1) + 1 for i, c in enumerate(p)))
        best = max(parts, key=lambda label: plain_modularity(links, label))
        assert all(best[v] == best[want[v]] for v in near)
    monkeypatch.setattr(cm, "_level", None)
    edges = [(10 * c + a, 10 * c + b) for c in range(6) for a, b in itertools.combinations(range(c + 2), 2)]
    for score in (cm.MODULARITY, cm.MAP_EQUATION):
        labels, levels = cm.multilevel(spark.createDataFrame(edges, "src long, dst long"), score)
        assert labels_of(labels) == {v: v // 10 * 10 for e in edges for v in e} and [x[1] for x in levels] == [27, 6]
