"""Operators on small tables: nulls, repeats, edges of windows, files."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.crawl import evaluation as ev
from gleaner.functions import columns as fn
from gleaner.operators import graph as g
from gleaner.operators import table as tb
from gleaner.operators import windows as wd
from gleaner.plans import catalogue, views
from gleaner.sources import files
from gleaner.sources.catalog import GraphCatalog

T7 = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5), (5, 6), (6, 7)]


@pytest.fixture(scope="module")
def t7(spark):
    return spark.createDataFrame(T7, "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bags(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    values = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert values(tb.union(a, b)) == [1, 2, 3, 3, None]
    assert values(tb.union(a, b, dedup_right=True)) == [1, 2, 3, None]
    assert values(tb.intersection(a, b)) == [1, None]
    assert values(tb.minus(a, b)) == [2]
    assert values(tb.minus(a, b.limit(0))) == [1, 1, 2, None]


def test_row_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = tb.row_numbers(df, ["x"])
    assert [r["_id"] for r in got.orderBy("x").collect()] == list(range(1000))
    assert tb.row_numbers(df.limit(0), ["x"]).count() == 0


def test_update_from_takes_the_last_of_repeated_keys(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, v double")
    other = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2)], "f int, r double, o int")
    assert rows(tb.update_from(left, "k", "v", other, "f", "r", "o", -1.0)) == [(1, 6.0), (2, -1.0)]


def test_threshold_join_counts_joint_rows(spark):
    a = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "k string, j int")
    got = rows(tb.threshold_join(a, "k", "j", a, "k", "j", 2))
    assert got == [("a", "a", 5)]


def test_threshold_joins_against_plain_loops(spark):
    left = [(i, None if i % 11 == 0 else f"k{i % 5}", None if i % 7 == 0 else (i * i) % 6) for i in range(60)]
    right = [(100 - i, i % 4, (i * 5) % 9) for i in range(40)]
    a, b = spark.createDataFrame(left, "i int, k string, v int"), spark.createDataFrame(right, "j int, q int, v int")
    joint = sorted((x, y) for x in left for y in right if x[2] is not None and x[2] == y[2])
    groups, single = {}, {}
    tidy = lambda found: sorted(map(tuple, found), key=str)
    for x, y in joint:
        groups.setdefault((x[1], y[1]), []).append((x[0], y[0], x, y))
        single.setdefault((x[1], y[1], x[2]), []).append((x[0], y[0], x, y))
    for least in (1, 2, 9, 30):
        got = tb.threshold_join(a, "k", "v", b, "q", "v", least)
        assert tidy(got.collect()) == tidy((*k, len(m)) for k, m in groups.items() if len(m) >= least)
        assert "hashpartitioning(key1" not in got._jdf.queryExecution().toString()
        each = tb.threshold_join(a, "k", "v", b, "q", "v", least, per_value=True)
        assert tidy(each.collect()) == tidy((*k, len(m)) for k, m in single.items() if len(m) >= least)
        assert "hashpartitioning(key1" not in each._jdf.queryExecution().toString()
        for found, per_value in ((groups, False), (single, True)):
            best = tb.threshold_join_rows(a, "k", "v", "i", b, "q", "v", "j", least, per_value)
            assert best.columns == ["i", "k", "v-1", "j", "q", "v-2"]
            assert tidy(best.collect()) == tidy(sum(min(m)[2:], ()) for m in found.values() if len(m) >= least)


def test_similarity_join_is_a_theta_join(spark):
    pts = [(i, float(i * 37 % 23), float(i * 11 % 17)) for i in range(60)]
    df = spark.createDataFrame(pts, "i int, x double, y double")
    got = {(r["i-1"], r["i-2"]) for r in tb.similarity_join(df, ["x", "y"], df, ["x", "y"], "d", 3.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if math.hypot(p[1] - q[1], p[2] - q[2]) <= 3.0}


def test_group_jaccard_beyond_one_has_disjoint_pairs(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9)], "g string, v int")
    got = rows(tb.group_jaccard(df, ["g"], "v", 1.0))
    assert len(got) == 9 and ("a", "c", 1.0) in got


def test_group_jaccard_shuffles_lists_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(tb, "LIST", 2)  # a value's groups fall into several lists
    sets = {g: {v for v in range(12) if (g * 7 + v * 5) % 11 < 4} for g in range(7)} | {None: {1, 2}, 9: {50}}
    df = spark.createDataFrame([(g, v) for g, vs in sets.items() for v in [*vs, *vs, None]], "g int, v int")
    want = {(a, b): 1 - len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items()}
    for threshold in (0.7, 1.0):
        out = tb.group_jaccard(df, ["g"], "v", threshold)
        got = out.collect()
        assert {(r[0], r[1]): round(r[2], 9) for r in got} == {k: round(d, 9) for k, d in want.items() if d <= threshold} and len(got) == len({(r[0], r[1]) for r in got})
        assert not re.search(r"hashpartitioning\(g1#\w+, g2#", out._jdf.queryExecution().toString())
    arcs = df.where("g is not null and v is not null").select(F.col("g").alias("src"), (F.col("v") + 100).alias("dst"))
    out = g.knn_jaccard(arcs, 2)
    near = {a: sorted((want[a, b], b) for b in sets if b not in (a, None) and want[a, b] < 1)[:2] for a in sets if a is not None}
    assert sorted((r["src"], r["rank"], r["other"]) for r in out.collect()) == sorted((a, i + 1, b) for a, bs in near.items() for i, (_, b) in enumerate(bs))
    assert not re.search(r"hashpartitioning\((g1|src)#\w+, (g2|other)#", out._jdf.queryExecution().toString())


def test_windows(spark):
    df = spark.createDataFrame([(v,) for v in (0, 6, 7, 13, 20)], "v int")
    buckets = lambda **k: rows(wd.split_windows(df, "v", **k).select("v", "bucket"))
    assert buckets(window=7, jump=7) == [(0, 0), (6, 0), (7, 1), (13, 1), (20, 2)]
    assert (7, 1) in buckets(window=7, jump=3) and (7, 0) not in buckets(window=7, jump=3)
    assert [b for v, b in buckets(window=7, jump=0) if v == 0] == [0, 1, 2]
    assert rows(wd.split_intervals(df, "v", [(0, 7), (6, 14)]).select("v", "bucket")) == [(0, 0), (6, 0), (6, 1), (7, 1), (13, 1)]
    assert wd.split_windows(df.limit(0), "v", 7, 7).count() == 0


def test_days_round_as_sql_does(spark, tmp_path):
    """A time in the last half second of a day counts for the next one; halves go to the even second, and times before 1970 to the day that is nearer."""
    duck = duckdb.connect()
    times = ["2024-01-01 23:59:59.2", "2024-01-05 23:59:59.5", "2024-01-06 23:59:59.7", "2024-01-07 23:59:59.499999", "2024-01-09 23:59:59.999999", "2024-01-30 23:59:59.6"]
    early = ["1969-12-20 12:00:00", "1969-12-26 23:59:59.7", "1969-12-31 01:00:00", "1970-01-01 00:00:00.5", "1970-01-06 23:59:59.5", "1970-01-11 23:59:59.4"]
    for name, stamps in (("late", times), ("early", early)):
        folder = tmp_path / name
        folder.mkdir()
        values = ", ".join(f"({i}, TIMESTAMP '{t}', {i % 3})" for i, t in enumerate(stamps))
        duck.execute(f"COPY (SELECT * FROM (VALUES {values}) v(event_id, ts, user_id)) TO '{folder}/events.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        for query in ("tbl_win_tumbling", "tbl_win_sliding", "tbl_win_expanding", "tbl_win_intervals"):
            assert rows(catalogue.queries()[query](spark, str(folder))) == sorted(duck.execute(catalogue.oracle_sql()[query]).fetchall()), (name, query)


def test_copurchase_tasks_follow_the_lines(spark, data, monkeypatch):
    want = rows(views.copurchase(spark, data, 2))
    monkeypatch.setattr(tb, "TASK_ROWS", 100)
    df = views.copurchase(spark, data, 2)
    assert rows(df) == want
    assert df.rdd.getNumPartitions() == 2 * -(-views.table(spark, data, "lineitem").count() // 100)


def test_cascades(spark):
    e = spark.createDataFrame([(1, 10, 11, 0), (2, 11, 12, 5), (3, 12, 13, 9), (4, 50, 51, 0)], "id long, s long, t long, start long")
    edges = wd.cascade_edges(e, "id", "s", "t", "start", F.lit(2), 5)
    assert rows(edges) == [(1, 2), (2, 3)]
    assert rows(wd.cascades(edges)) == [(1, 1), (1, 2), (1, 3)]


def test_graph_on_the_toy(spark, t7):
    c = {r["id"]: r for r in g.clustering(t7).collect()}
    assert c[1]["cc"] == 1.0 and c[7]["cc"] == 0.0 and c[2]["triangles"] == 1
    assert {r["id"]: r["hop"] for r in g.hops(t7, spark.range(1, 2)).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 4}
    assert g.shortest_path(t7, 1, 7) == 4
    assert rows(g.k_core(t7, 2)) == T7[:6]
    assert g.k_core(t7, 4).count() == 0
    m = g.distance_measures(g.hops(t7, spark.range(1, 2)), 7).first()
    assert m["eccentricity"] == 4 and m["closeness"] == pytest.approx(6 / 13)
    assert not g.is_tree(t7) and g.is_tree(g.star(spark, 5))


def test_betweenness_of_a_path(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in g.betweenness(path, g.nodes_of(path)).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


def test_betweenness_takes_blocks_together(spark, monkeypatch):
    """Blocks of sources go through the levels at once as long as their pairs fit on the disk, and through cells of any size."""
    ring = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)] + [(0, 9), (20, 21)], "src long, dst long").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    runs, plain = [], g._dependencies
    monkeypatch.setattr(g, "_dependencies", lambda *a, **k: runs.append(1) or plain(*a, **k))
    monkeypatch.setattr(g, "CELL_PAIRS", 8, raising=False)
    assert dict(rows(g.betweenness(ring, g.nodes_of(ring), block=4))) == pytest.approx({0: 9.0, 1: 5.0, 2: 4.0, 3: 3.0, 4: 3.0, 5: 4.0, 6: 5.0, 9: 0.0, 20: 0.0, 21: 0.0})
    assert len(runs) == 1


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = g.components(path.unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (7, 7)], "src long, dst long")))
    assert dict(got.groupBy("component").count().collect()) == {0: 301, 1000: 2}
    assert g.components(path.limit(0)).count() == 0


def test_strong_components(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    assert rows(g.strong_components(arcs)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]


def test_page_rank_sums_to_one(spark, t7):
    got = g.page_rank(g.both_ways(t7), g.nodes_of(t7))
    assert got.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_weighted_distances(spark):
    arcs = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0)], "src long, dst long, weight double")
    assert {r["id"]: r["distance"] for r in g.weighted_distances(arcs, spark.range(1, 2)).collect()} == {1: 0.0, 2: 2.0, 3: 1.0, 4: 3.0}


def test_growth():
    for kind in ("preferential", "copying", "forest_fire", "small_world"):
        e = g.growth_graph(40, 2, 1, kind)
        assert len(e) and (e.src < e.dst).all() and not e.duplicated().any()


def test_edge_files(spark, tmp_path):
    f = tmp_path / "e.ij"
    f.write_text("# c\n% c\n2 1\n1 2\n3 3\nx y\n2 4\n")
    assert rows(files.edge_list(spark, str(f))) == [(1, 2), (2, 4)]
    f.write_text("% sym\n9,7,0.5\n7\t3 1\n9 9\n")
    assert rows(files.raw_edge_list(spark, str(f))) == [(7, 3), (9, 7)]
    assert rows(files.raw_edge_list(spark, str(f), renumber=True)) == [(0, 1), (1, 2)]
    f.write_text("b a\na c\n")
    edges, numbers = files.edge_list_named(spark, str(f))
    assert rows(numbers) == [("a", 1), ("b", 0), ("c", 2)] and rows(edges) == [(0, 1), (1, 2)]
    f.write_text("1 2 3\n2 3\n")
    assert rows(files.adjacency_list(spark, str(f))) == [(1, 2), (1, 3), (2, 3)]
    f.write_text('*Vertices 2\n1 "one"\n2 "two"\n*Arcs\n1 2 1\n*Edges\n2 1\n')
    vertices, edges = files.pajek(spark, str(f))
    assert rows(vertices) == [(1, "one"), (2, "two")] and rows(edges) == [(1, 2, True), (2, 1, False)]


def test_catalog_and_attributes(spark, tmp_path):
    cat = GraphCatalog(spark, str(tmp_path))
    cat.register(spark.createDataFrame(T7 + [(20, 21)], "src long, dst long"), "toys", "t7")
    assert cat.get("toys", "t7").count() == 9 and cat.get("toys", "t7", giant_only=True).count() == 8
    assert cat.name(cat.path("toys", "t7")) == ("toys", "t7")
    f = tmp_path / "a.json"
    f.write_text('{"7": {"smoking": 3}, "8": {"x": 1}}')
    assert rows(files.attribute(spark, str(f), ("smoking",)))[0] == (7, "3")
    assert {r["id"]: r["value"] for r in files.attribute(spark, str(f), ("smoking",)).collect()}[8] is None


def test_delimited_tables(spark, tmp_path):
    f = tmp_path / "t.tsv"
    f.write_text("# a\tb\tc\n1\t2.5\tx\n2\t3\ty\n")
    got = files.read_table(spark, str(f), columns=["a", "c"])
    assert rows(got) == [(1, "x"), (2, "y")]


def test_measures():
    assert ev.exponential_steps(5) == [1, 2, 3, 4, 5]
    assert ev.exponential_steps(30) == list(range(1, 31))
    assert len(ev.exponential_steps(100)) == 62 and ev.exponential_steps(100)[-6:] == [81, 85, 89, 93, 97, 100]
    assert len(ev.exponential_steps(1000)) == 111 and ev.exponential_steps(1000)[-3:] == [919, 964, 1000]


def test_curve_goldens(spark):
    h = spark.createDataFrame([("g", 0, 0.0), ("g", 1, 1.0), ("g", 2, 1.0), ("g", 4, 3.0)], "graph string, step int, value double")
    m = ev.curve_measures(h, ["graph"]).first()
    assert (m["aucc"], m["waucc"], m["tc"]) == (1.375, 1.0, 3.0)


def test_next_instances(spark):
    schema = "graph string, instance int, step int, value double"
    old = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 1, 2.0)], schema)
    new = spark.createDataFrame([("g", 0, 1, 2.0), ("g", 1, 1, 3.0)], schema)
    assert rows(ev.next_instances(old, new, ["graph"])) == [("g", 2, 1, 3.0)]


def test_observed_by_step(spark, t7):
    log = spark.createDataFrame([("r", 1, 1), ("r", 2, 3), ("r", 3, 5)], "run_id string, step int, node long")
    assert [r["observed"] for r in ev.observed_by_step(log, g.both_ways(t7)).orderBy("step").collect()] == [2, 2, 3]


def test_column_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(fn.domain_name(F.lit("HTTP://user@www.Example.org:80/a?b"))) == "example.org"
    assert get(fn.normalized_url(F.lit("https://www.Example.org/x/index.html#top"))) == "http://example.org/x"
    assert get(fn.without_tags(F.lit("<p>a<b>b</b></p><script>x<y</script> c"))) == "a b c"
    assert get(fn.upper_median(F.array(*(F.lit(x) for x in (4, 1, 3, 2))))) == 3
    assert get(fn.count_words(F.lit("A b, c-d"))) == 4
    assert get(fn.is_latin(F.lit("naïve"))) and not get(fn.is_latin(F.lit("мир")))
    assert get(fn.histogram_slot(F.lit(1.0), 3)) == 2


def test_strong_components_says_when_nodes_are_left(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 5)], "src long, dst long")
    with pytest.raises(RuntimeError):
        g.strong_components(chain, max_rounds=1)
    assert rows(g.strong_components(chain)) == [(i, i) for i in range(1, 6)]


def test_strong_components_of_all_events(spark, data):
    arcs = {tuple(r) for r in views.event_intervals(spark, data).select("source", "target").distinct().collect()}
    nodes = {v for a in arcs for v in a if v is not None}
    to = {}
    for a, b in arcs:
        to.setdefault(a, []).append(b)

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for u in to.get(todo.pop(), ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        return seen

    far = {v: reach(v) for v in nodes}
    assert rows(catalogue.queries()["g_strong_components"](spark, data)) == sorted((v, min(u for u in far[v] if v in far[u])) for v in nodes)


def test_betweenness_from_all_sources(spark, data):
    """Brandes' algorithm over every customer; blocks of sources don't change sums."""
    e = views.customer_graph(spark, data)
    to = {}
    for r in e.collect():
        to.setdefault(r["src"], []).append(r["dst"])
        to.setdefault(r["dst"], []).append(r["src"])
    want = dict.fromkeys(to, 0.0)
    for s in to:
        hop, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in to[v]:
                if u not in hop:
                    hop[u], paths[u] = hop[v] + 1, 0.0
                    order.append(u)
                if hop[u] == hop[v] + 1:
                    paths[u] += paths[v]
        flow = dict.fromkeys(order, 0.0)
        for v in reversed(order[1:]):
            want[v] += flow[v] / 2
            for u in to[v]:
                if hop[u] == hop[v] - 1:
                    flow[u] += paths[u] / paths[v] * (1 + flow[v])
    got = {r["id"]: r["betweenness"] for r in catalogue.queries()["g_betweenness"](spark, data).collect()}
    assert got == pytest.approx(want, abs=1e-5)
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "src long, dst long")
    assert {r["id"]: r["betweenness"] for r in g.betweenness(star, g.nodes_of(star), block=2).collect()} == {0: 10.0, **dict.fromkeys(range(1, 6), 0.0)}


def test_betweenness_writes_no_levels_where_tasks_hold_the_graph(spark, monkeypatch):
    """A long graph takes one job over its sources, and the levels by joins give the same."""
    pairs = [(i, i + 1) for i in range(5)] + [(1, 4), (0, 5), (8, 9)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    some = spark.createDataFrame([(0,), (2,), (5,), (99,)], "id long")
    written, plain = [], g.materialize_counted
    monkeypatch.setattr(g, "materialize_counted", lambda df, name: written.append(name) or plain(df, name))
    monkeypatch.setattr(g, "TASK_PAIRS", 16)  # two sources at once
    whole = [dict(rows(g.betweenness(e, some))), {r[:2]: r[2] for r in rows(g.edge_betweenness(e, some))}]
    assert "level" not in written and len(whole[0]) == 6 and len(whole[1]) == len(pairs)
    monkeypatch.setattr(g, "TASK_PAIRS", 1)
    assert dict(rows(g.betweenness(e, some))) == pytest.approx(whole[0])
    assert {r[:2]: r[2] for r in rows(g.edge_betweenness(e, some))} == pytest.approx(whole[1])
    monkeypatch.setattr(g, "TASK_ARCS", 0)
    assert dict(rows(g.betweenness(e, some, block=2))) == pytest.approx(whole[0])
    assert {r[:2]: r[2] for r in rows(g.edge_betweenness(e, some, block=2))} == pytest.approx(whole[1]) and "level" in written


def test_group_jaccard_sends_a_list_once_a_block(spark, monkeypatch):
    """Lists meet in cells of blocks, of any width, and pairs that share nothing aren't made from a table of those that do."""
    sets = {k: {v for v in range(9) if (k * 5 + v * 3) % 7 < 3} for k in range(11)} | {20: {77}}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "g int, v int")
    want = {(a, b): round(1 - len(x & y) / len(x | y), 9) for a, x in sets.items() for b, y in sets.items()}
    written, plain = [], tb.materialize
    monkeypatch.setattr(tb, "materialize", lambda df, name: written.append(name) or plain(df, name))
    for width in (1, 5, 64):
        monkeypatch.setattr(tb, "LIST", width)
        monkeypatch.setattr(tb, "LEAST_LISTS", 1)
        out = tb.group_jaccard(df, ["g"], "v", 1.0)
        assert {r[:2]: round(r[2], 9) for r in rows(out)} == want and out.count() == len(want)
        assert "hashpartitioning(g1" not in out._jdf.queryExecution().toString()
    assert "pairs" not in written
    cells = spark.createDataFrame([(0, 0, [0, 1, 4], None), (0, 0, [1], None), (0, 1, [0, 4], [2, 3]), (0, 1, [4], [3])], "b1 long, b2 long, l1 array<short>, l2 array<short>").toArrow().to_batches()
    monkeypatch.setattr(tb, "SPREAD", 4)
    got = {(r["g1"], r["g2"]): r["c"] for b in tb._cell_counts(iter(cells), 5, 10, False) for r in b.to_pylist()}
    near = {(0, 0): 1, (0, 1): 1, (0, 4): 1, (1, 1): 2, (1, 4): 1, (4, 4): 1, (0, 7): 1, (0, 8): 1, (4, 7): 1, (4, 8): 2}
    assert got == near | {(b, a): c for (a, b), c in near.items()}


def test_threshold_join_sends_no_block_to_its_cells(spark, monkeypatch):
    """Each block is written once and read by the tasks of its cells: nothing is shuffled by cell, however many blocks there are."""
    monkeypatch.setattr(tb, "BLOCK_ROWS", 4)
    monkeypatch.setattr(tb, "LEAST_BLOCKS", 1)
    left = [(i, i % 9, (i * i) % 13) for i in range(50)]
    a = spark.createDataFrame(left, "i int, k int, v int")
    n = {}
    for x in left:
        for y in left:
            if x[2] == y[2]:
                n.setdefault((x[1], y[1]), []).append((x[0], y[0]))
    counted, best = tb.threshold_join(a, "k", "v", a, "k", "v", 3), tb.threshold_join_rows(a, "k", "v", "i", a, "k", "v", "i", 3)
    assert rows(counted) == sorted((*k, len(m)) for k, m in n.items() if len(m) >= 3)
    assert rows(best.select("k-1", "k-2", "i-1", "i-2")) == sorted((*k, *min(m)) for k, m in n.items() if len(m) >= 3)
    for out in (counted, best):
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" in plan and "hashpartitioning(cell" not in plan
    assert rows(tb.threshold_join(a.where("i < 0"), "k", "v", a, "k", "v", 3)) == []


def test_ranks_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "src long, dst long")
    few = dict(rows(g.eigenvector_centrality(e, rounds=3, tolerance=0.0)))
    plans, plain = [], g.materialize
    monkeypatch.setattr(g, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name))
    monkeypatch.setattr(g, "JOINED_NODES", 3, raising=False)
    assert dict(rows(g.eigenvector_centrality(e, rounds=3, tolerance=0.0))) == pytest.approx(few)
    g.page_rank(g.both_ways(e), g.nodes_of(e), rounds=2).collect()
    steps = [p for name, p in plans if name in ("eigen", "rank") and "Join" in p]
    assert len(steps) == 5 and not any("BroadcastHashJoin" in p for p in steps)
