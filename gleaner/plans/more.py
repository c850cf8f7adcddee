"""Further registered queries: files written and read back, parts of crawls, and more graph operators, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.crawl import evaluation as ev
from gleaner.crawl import presets, store
from gleaner.functions import columns as fn
from gleaner.operators import communities as cm
from gleaner.operators import cuts
from gleaner.operators import features as ft
from gleaner.operators import graph as g
from gleaner.operators import networks as nw
from gleaner.operators import table as tb
from gleaner.operators import windows as wd
from gleaner.plans import views
from gleaner.plans.catalogue import _AB, _BRIDGES, _COP, _CUST, _EV, _HIST, _LOG, _STATE, _TRI, _ab, _log, _means, _query, _r, _round, _state
from gleaner.plans.views import table
from gleaner.session import shared_folder
from gleaner.sources import files
from gleaner.sources.catalog import GraphCatalog


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _text(df, path: str, *columns, separator: str = " ", head: str | None = None) -> str:
    """Lines of columns as one file, after a head."""
    lines = df.select(F.concat_ws(separator, *columns).alias("value"))
    if head is not None:
        lines = df.sparkSession.range(1).select(F.explode(F.split(F.lit(head), "\n")).alias("value")).unionByName(lines)
    lines.coalesce(1).write.text(path)
    return path


# Files

_ORDER_PARTS = "SELECT DISTINCT least(o_custkey, o_orderkey % 97) AS src, greatest(o_custkey, o_orderkey % 97) AS dst FROM orders WHERE o_custkey <> o_orderkey % 97"


def _order_pairs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97).alias("b"))


@_query(_ORDER_PARTS)
def src_edge_list(spark, sf):
    return files.edge_list(spark, _text(_order_pairs(spark, sf), _folder(spark), "a", "b", head="# nodes\n% more\n\nx y\n7"))


@_query(_ORDER_PARTS)
def src_edge_list_separated(spark, sf):
    return files.edge_list(spark, _text(_order_pairs(spark, sf), _folder(spark), "a", F.lit("z"), "b", separator=","), 0, 2, ",")


@_query("SELECT DISTINCT least(a, b) AS one, greatest(a, b) AS other FROM (SELECT 'p' || CAST(p_size AS VARCHAR) AS a, p_brand AS b FROM part) WHERE a <> b")
def src_edge_list_named(spark, sf):
    path = _text(table(spark, sf, "part"), _folder(spark), F.concat(F.lit("p"), F.col("p_size").cast("string")), "p_brand", separator="\t", head="# names")
    edges, numbers = files.edge_list_named(spark, path, "\t")
    a, b = (numbers.select(F.col("number").alias(n), F.col("name").alias(x)) for n, x in (("src", "x"), ("dst", "y")))
    return edges.join(a, "src").join(b, "dst").select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other"))


@_query("SELECT DISTINCT least(s_suppkey, s_nationkey + 1000) AS src, greatest(s_suppkey, s_nationkey + 1000) AS dst FROM supplier")
def src_adjacency_list(spark, sf):
    own = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.collect_list("s_suppkey"), lambda x: x.cast("string")), " ").alias("near"))
    return files.adjacency_list(spark, _text(own, _folder(spark), F.col("s_nationkey") + 1000, "near", head="# lines"))


@_query("SELECT DISTINCT least('n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR)) AS one, greatest('n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR)) AS other FROM supplier")
def src_adjacency_list_named(spark, sf):
    own = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.collect_list("s_suppkey"), lambda x: F.concat(F.lit("s"), x.cast("string"))), " ").alias("near"))
    edges, numbers = files.adjacency_list_named(spark, _text(own, _folder(spark), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "near"))
    a, b = (numbers.select(F.col("number").alias(n), F.col("name").alias(x)) for n, x in (("src", "x"), ("dst", "y")))
    return edges.join(a, "src").join(b, "dst").select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other"))


@_query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS src, CAST(n_regionkey + 1 AS BIGINT) AS dst, n_nationkey % 2 = 0 AS directed, n_name AS label FROM nation ORDER BY 1")
def src_pajek(spark, sf):
    n = sorted((r["n_nationkey"], r["n_regionkey"], r["n_name"]) for r in table(spark, sf, "nation").collect())
    pairs = lambda odd: "\n".join(f"{a + 1} {b + 1}" for a, b, _ in n if a % 2 == odd)
    text = f"*Vertices {len(n)}\n" + "\n".join(f'{a + 1} "{x}"' for a, _, x in n) + f"\n*Arcs\n{pairs(0)}\n*Edges\n{pairs(1)}"
    path = _folder(spark)
    spark.range(1).select(F.lit(text)).write.text(path)
    vertices, edges = files.pajek(spark, path)
    return edges.join(vertices, edges["src"] == vertices["id"]).select("src", "dst", "directed", "label")


@_query("SELECT o_custkey AS src, o_orderkey AS dst, round(o_totalprice, 2) AS price, o_orderstatus AS status FROM orders")
def src_edge_attributes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.format_string("%.2f", "o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    path = _folder(spark)
    files.write_edge_list(o, path, "\t", "orders of customers", ["price", "status"])
    return files.edge_list_with(spark, path, "src long, dst long, price double, status string", "\t").select("src", "dst", _r("price", 2), "status")


@_query(f"WITH {_CUST} SELECT '# customers' AS value UNION ALL SELECT '# Nodes: ' || CAST((SELECT count(DISTINCT src) FROM adj) AS VARCHAR) || ' Edges: ' || CAST((SELECT count(*) FROM edges) AS VARCHAR) UNION ALL SELECT '# src dst' UNION ALL SELECT CAST(src AS VARCHAR) || ' ' || CAST(dst AS VARCHAR) FROM edges")
def src_save_edge_list(spark, sf):
    path = _folder(spark)
    files.write_edge_list(views.customer_graph(spark, sf), path, description="customers")
    return spark.read.text(path)


@_query("SELECT o_custkey AS src, o_orderkey % 97 AS dst FROM orders WHERE o_custkey <> o_orderkey % 97")
def src_reformat(spark, sf):
    path = _text(_order_pairs(spark, sf), _folder(spark), "b", "a", F.lit("0.5"), separator=", ", head="% raw\n1 1")
    return files.raw_edge_list(spark, path, columns="ji")


@_query("SELECT p_partkey AS id, p_brand AS value FROM part")
def src_attribute(spark, sf):
    path = _folder(spark)
    files.write_attribute(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("value")), path)
    return files.attribute(spark, path, ["brand"])


@_query(f"WITH {_CUST} SELECT src, dst FROM edges")
def src_catalog(spark, sf):
    catalog = GraphCatalog(spark, _folder(spark))
    catalog.register(views.customer_graph(spark, sf), "own", "customers")
    return catalog.get(*catalog.name(catalog.path("own", "customers")))


@_query("SELECT c_custkey AS node, CAST(c_nationkey AS VARCHAR) AS value FROM customer")
def src_catalog_attribute(spark, sf):
    catalog = GraphCatalog(spark, _folder(spark))
    catalog.set_attribute(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")), "own", "customers", attribute="nation")
    return catalog.attribute("own", "customers", attribute="nation").select(F.col("id").alias("node"), "value")


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_table(spark, sf):
    path = _folder(spark)
    files.write_table(table(spark, sf, "customer"), path)
    return files.read_table(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", ["c_custkey", "c_name", "c_acctbal"], header=True)


@_query("SELECT 's_suppkey' AS name, 'bigint' AS kind UNION ALL SELECT 's_name', 'string' UNION ALL SELECT 's_nationkey', 'bigint' UNION ALL SELECT 's_acctbal', 'double'")
def src_schema(spark, sf):
    path = _folder(spark)
    files.dump(table(spark, sf, "supplier").coalesce(1), path)
    found = files.infer_schema(spark, path)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found], "name string, kind string")


@_query("SELECT '# s_suppkey' || chr(9) || 's_acctbal' AS value UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || chr(9) || printf('%.6f', s_acctbal) FROM supplier")
def src_dump(spark, sf):
    path = _folder(spark)
    files.dump(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), path)
    return spark.read.text(path)


@_query("SELECT * FROM supplier")
def src_binary(spark, sf):
    path = _folder(spark)
    files.save(table(spark, sf, "supplier"), path)
    return files.load(spark, path)


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey * 1.5 AS DOUBLE) AS value FROM nation")
def src_from_map(spark, sf):
    return files.from_map(spark, {int(r["n_nationkey"]): r["n_regionkey"] * 1.5 for r in table(spark, sf, "nation").collect()}, "nation", "value")


@_query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, 'SOUTH'")
def src_append_rows(spark, sf):
    return files.append_rows(table(spark, sf, "region").select("r_regionkey", "r_name"), [(90, "NORTH"), (91, "SOUTH")])


@_query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT c_custkey, s_name AS guest FROM a LEFT JOIN b USING (i)")
def src_append_column(spark, sf):
    return files.append_column(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], table(spark, sf, "supplier"), "s_name", ["s_suppkey"], "guest")


@_query("SELECT CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS BIGINT) AS at, s_acctbal AS value FROM supplier")
def src_read_column(spark, sf):
    values = files.read_column(table(spark, sf, "supplier"), "s_acctbal", ["s_acctbal", "s_suppkey"])
    return spark.createDataFrame(list(enumerate(values)), "at long, value double")


@_query(f"WITH {_CUST}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT src AS id FROM adj)) SELECT x.k AS src, y.k AS dst FROM adj JOIN n x ON x.id = adj.src JOIN n y ON y.id = adj.dst")
def src_dense_arcs(spark, sf):
    return files.dense_arcs(views.customer_graph(spark, sf))[0]


@_query(f"WITH {_CUST} SELECT CAST(src + 1 AS VARCHAR) || chr(9) || CAST(dst + 1 AS VARCHAR) AS value FROM adj UNION ALL SELECT CAST(c_custkey + 1 AS VARCHAR) || chr(9) || CAST(c_nationkey + 1 AS VARCHAR) FROM customer")
def src_benchmark(spark, sf):
    path = _folder(spark)
    files.write_benchmark(views.customer_graph(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community")), path)
    return spark.read.text(f"{path}/network").unionByName(spark.read.text(f"{path}/community"))


@_query(_HIST + "SELECT graph, crawler, instance, step, value FROM h WHERE step BETWEEN 10 AND 40")
def src_results(spark, sf):
    path = _folder(spark)
    store.save(views.histories(spark, sf).select("graph", "crawler", F.lit("recall").alias("metric"), F.lit(49).alias("budget"), "instance", "step", "value"), path)
    return store.read(spark, path, 10, 40).select("graph", "crawler", "instance", "step", "value")


# Tables


@_query(
    """WITH j AS (SELECT a.o_custkey AS k1, b.o_custkey AS k2, a.o_orderkey AS i, b.o_orderkey AS j FROM orders a JOIN orders b ON a.o_orderdate = b.o_orderdate)
    SELECT k1 AS "o_custkey-1", min(i) AS "o_orderkey-1", k2 AS "o_custkey-2", arg_min(j, (i, j)) AS "o_orderkey-2" FROM j GROUP BY k1, k2 HAVING count(*) >= 2"""
)
def tbl_threshold_join_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    out = tb.threshold_join_rows(o, "o_custkey", "o_orderdate", "o_orderkey", o, "o_custkey", "o_orderdate", "o_orderkey", 2)
    return out.select("o_custkey-1", "o_orderkey-1", "o_custkey-2", "o_orderkey-2")


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 15")
def tbl_bottom_k(spark, sf):
    return tb.bottom(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 15)


@_query("WITH b AS (SELECT CAST(floor(log2(l_quantity)) AS INT) AS i, count(*) AS n FROM lineitem WHERE l_quantity >= 1 GROUP BY 1) SELECT power(2.0, i) AS low, power(2.0, i + 1) AS high, n, round(n / sum(n) OVER () / power(2.0, i), 6) AS pdf, round(sum(n) OVER (ORDER BY i) / sum(n) OVER (), 6) AS cdf FROM b")
def tbl_exponential_bins(spark, sf):
    out = tb.exponential_bins(table(spark, sf, "lineitem").select((F.col("l_quantity") + 0.0).alias("q")), "q")
    return out.select("low", "high", "n", _r("pdf"), _r("cdf"))


@_query("SELECT p_partkey, CAST(p_size + 2 AS BIGINT) AS cut, round(CAST(p_size * 2.75 AS DOUBLE), 6) AS whole, CAST(p_size // 7 AS BIGINT) AS parts FROM part")
def tbl_arith_literal(spark, sf):
    a = F.col("p_size").cast("long")
    return table(spark, sf, "part").select("p_partkey", fn.arithmetic_with("add", a, 2.75, True).alias("cut"), _round(fn.arithmetic_with("mul", a, 2.75, False), 6).alias("whole"), fn.arithmetic_with("div", a, 7.9, True).alias("parts"))


@_query(_AB + "SELECT l_partkey, l_suppkey, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def tbl_group_two_keys(spark, sf):
    return tb.aggregate(tb.union_all(*_ab(spark, sf)), ["l_partkey", "l_suppkey"], {"n": ("count", "l_partkey")}, "l_partkey")


@_query("SELECT CAST(epoch(TIMESTAMP '2020-01-01') AS BIGINT) + n_nationkey * 86400 AS at, lower(replace(n_name, ' ', '_')) AS name, CAST(n_nationkey % 3 + 1 AS INT) AS lines FROM nation")
def u_times_names(spark, sf):
    n = table(spark, sf, "nation")
    text = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_nationkey")), "dd.MM.yyyy")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_nationkey") % 3 + 1), lambda i: F.concat(F.lit(" line "), i.cast("string"))), "\n\n")
    return n.select(F.unix_timestamp(fn.time_of(text)).alias("at"), fn.standard_name(F.col("n_name")).alias("name"), F.size(fn.lines(many)).alias("lines"))


# Windows


@_query(_EV + "SELECT CAST((start - (SELECT min(start) FROM e)) // 604800 AS BIGINT) AS bucket, count(*) AS n, min(id) AS first FROM e GROUP BY 1")
def tbl_each_window(spark, sf):
    out = None
    for bucket, rows in wd.each_window(wd.split_windows(views.event_intervals(spark, sf), "start", 604800, 604800)):
        own = rows.agg(F.lit(bucket).cast("long").alias("bucket"), F.count("*").alias("n"), F.min("id").alias("first"))
        out = own if out is None else out.unionByName(own)
    return out


# Graphs


@_query(_EV + ", d AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT source AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY id) SELECT id, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree FROM d")
def g_directed_degrees(spark, sf):
    return g.directed_degrees(views.event_intervals(spark, sf).select(F.col("source").alias("src"), F.col("target").alias("dst")))


@_query(f"WITH {_CUST} SELECT true AS node, EXISTS (SELECT 1 FROM edges WHERE src = 4 AND dst = 8) AS edge, EXISTS (SELECT 1 FROM adj WHERE src = -5) AS other")
def g_has(spark, sf):
    e = views.customer_graph(spark, sf)
    return spark.createDataFrame([(g.has_node(e, 9), g.has_edge(e, 8, 4), g.has_node(e, -5))], "node boolean, edge boolean, other boolean")


@_query(f"WITH {_CUST} SELECT src, dst FROM edges UNION ALL SELECT DISTINCT src, src FROM adj")
def g_with_loops(spark, sf):
    return g.with_loops(views.customer_graph(spark, sf))


@_query(f"WITH {_CUST}, deg AS (SELECT src AS id, count(*) AS d FROM adj GROUP BY src) SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM deg WHERE d = 1) AND dst NOT IN (SELECT id FROM deg WHERE d = 1)")
def g_without_leaves(spark, sf):
    return g.without_degree(views.customer_graph(spark, sf), 1)


@_query("SELECT CAST(0 AS BIGINT) AS id")
def g_tree_root(spark, sf):
    return g.tree_root(g.tree(spark, 3, 4))


@_query(f"WITH {_CUST}, w AS (SELECT DISTINCT least(o_custkey, o_orderkey % 97) AS src, greatest(o_custkey, o_orderkey % 97) AS dst FROM orders) SELECT src, dst FROM edges JOIN w USING (src, dst)")
def g_edge_subgraph(spark, sf):
    return g.edge_subgraph(views.customer_graph(spark, sf), _order_pairs(spark, sf).select(F.col("b").alias("src"), F.col("a").alias("dst")))


@_query(f"WITH {_COP} SELECT x.src, x.dst, count(*) AS triangles FROM edges x JOIN adj a ON a.src = x.src JOIN adj b ON b.src = x.dst AND b.dst = a.dst GROUP BY 1, 2")
def g_triad_edges(spark, sf):
    return g.triad_edges(views.copurchase(spark, sf, 2))


@_query(f"WITH {_COP}{_TRI} SELECT id, t AS closed, CAST(d * (d - 1) // 2 - t AS BIGINT) AS open FROM cc")
def g_node_triads(spark, sf):
    return g.node_triads(views.copurchase(spark, sf, 2))


_BFS = "r(id, hop) AS (SELECT CAST(9 AS BIGINT), 0 UNION SELECT adj.dst, hop + 1 FROM r JOIN adj ON adj.src = r.id WHERE hop < 40), h AS (SELECT id, min(hop) AS hop FROM r GROUP BY id)"


@_query(f"WITH RECURSIVE {_CUST}, {_BFS} SELECT h.id, min(p.id) AS parent, h.hop FROM h LEFT JOIN (adj JOIN h p ON p.id = adj.dst) ON adj.src = h.id AND p.hop = h.hop - 1 GROUP BY h.id, h.hop")
def g_bfs_tree(spark, sf):
    return g.bfs_tree(views.customer_graph(spark, sf), spark.range(9, 10))


@_query(f"WITH RECURSIVE {_CUST}, {_BFS}, t AS (SELECT h.id, min(p.id) AS parent FROM h LEFT JOIN (adj JOIN h p ON p.id = adj.dst) ON adj.src = h.id AND p.hop = h.hop - 1 GROUP BY h.id), up(id, top) AS (SELECT id, id FROM t UNION ALL SELECT up.id, t.parent FROM up JOIN t ON t.id = up.top WHERE t.parent IS NOT NULL) SELECT top AS id, count(*) AS size FROM up GROUP BY top")
def g_subtree_sizes(spark, sf):
    return g.subtree_sizes(g.bfs_tree(views.customer_graph(spark, sf), spark.range(9, 10)))


@_query(f"WITH RECURSIVE {_CUST}, {_BFS} SELECT max(hop) AS diameter, round(avg(hop), 6) AS mean FROM h WHERE hop > 0")
def g_full_diameter(spark, sf):
    return g.full_diameter(g.hops(views.customer_graph(spark, sf), spark.range(9, 10))).select("diameter", _r("mean"))


@_query(
    f"""WITH RECURSIVE {_CUST}, {_BFS}, c AS (SELECT hop, sum(count(*)) OVER (ORDER BY hop) AS up_to FROM h GROUP BY hop), t AS (SELECT 0.9 * max(up_to) AS t FROM c), x AS (SELECT min(hop) AS hop FROM c, t WHERE up_to >= t),
    y AS (SELECT x.hop, (SELECT up_to FROM c WHERE c.hop = x.hop) AS hi, coalesce((SELECT up_to FROM c WHERE c.hop = x.hop - 1), 0) AS lo, t FROM x, t) SELECT round(CASE WHEN hop = 0 THEN 0 ELSE hop - 1 + (t - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS diameter FROM y"""
)
def g_effective_diameter(spark, sf):
    d = g.effective_diameter(g.hops(views.customer_graph(spark, sf), spark.range(9, 10)))
    return spark.createDataFrame([(d,)], "diameter double").select(_r("diameter"))


@_query(
    f"""WITH RECURSIVE {_CUST}, w AS (SELECT src, dst, CAST(1 + (src + dst) % 4 AS DOUBLE) AS w FROM adj), near(id, d) AS (SELECT CAST(9 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT w.dst, d + w.w FROM near JOIN w ON w.src = near.id WHERE d + w.w <= 12),
    best AS (SELECT id, min(d) AS d FROM near GROUP BY id) SELECT id, d AS distance FROM best WHERE d <= 12"""
)
def g_distances_within(spark, sf):
    arcs = g.both_ways(views.customer_graph(spark, sf)).withColumn("weight", 1.0 + (F.col("src") + F.col("dst")) % 4)
    return g.weighted_distances(arcs, spark.range(9, 10)).where("distance <= 12").select("id", "distance")


@_query(f"WITH {_COP}, r AS (SELECT d, row_number() OVER (ORDER BY d DESC, id) AS k, sum(d) OVER (ORDER BY d DESC, id ROWS UNBOUNDED PRECEDING) AS s FROM deg), z AS (SELECT k, k * (k - 1) / 2 + (SELECT sum(d) FROM deg) / 2 - s AS z FROM r) SELECT CAST(arg_min(k, (z, k)) AS BIGINT) AS core_size, CAST(min(z) AS DOUBLE) AS z FROM z")
def g_core_periphery(spark, sf):
    return nw.core_periphery(views.copurchase(spark, sf, 2))


@_query(
    f"""WITH {_CUST}, n AS (SELECT DISTINCT src AS id, src % 5 = 1 AS c FROM adj), p AS (SELECT CAST(x.c OR y.c AS INT) AS i, CAST(e.src IS NOT NULL AS INT) AS a FROM n x JOIN n y ON x.id < y.id LEFT JOIN edges e ON e.src = x.id AND e.dst = y.id)
    SELECT round(corr(i, a), 6) AS correlation FROM p"""
)
def g_core_fit(spark, sf):
    e = views.customer_graph(spark, sf)
    return nw.core_fit(e, g.nodes_of(e).where("id % 5 = 1")).select(_r("correlation"))


@_query(f"WITH {_COP}{_TRI} SELECT 'degree' AS name, d AS x, CAST(count(*) AS DOUBLE) AS y FROM deg GROUP BY d UNION ALL SELECT 'clustering', d, round(avg(cc), 6) FROM cc GROUP BY d UNION ALL SELECT 'triangles', t, count(*) FROM cc GROUP BY t UNION ALL SELECT 'neighbour_degree', d, round(avg(k), 6) FROM (SELECT a.src, avg(n.d) AS k FROM adj a JOIN deg n ON n.id = a.dst GROUP BY 1) q JOIN deg ON deg.id = q.src GROUP BY d")
def g_distributions(spark, sf):
    return g.distributions(views.copurchase(spark, sf, 2)).where("name <> 'component'").select("name", "x", _r("y"))


@_query(
    f"""WITH RECURSIVE {_CUST}, deg AS (SELECT src AS id, count(*) AS d FROM adj GROUP BY src){_TRI}, reach(id, c) AS (SELECT src, src FROM adj UNION SELECT adj.dst, reach.c FROM reach JOIN adj ON adj.src = reach.id WHERE reach.c < adj.dst), comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
    SELECT CAST(sum(CASE WHEN d = 1 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, round(sum(d) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 6) AS density, round(sum(t) / CAST(sum(d * (d - 1) / 2) AS DOUBLE), 6) AS transitivity, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0.0 END), 6) AS in_triangles,
    round((SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY c)) / CAST(count(*) AS DOUBLE), 6) AS largest_share FROM cc"""
)
def g_more_statistics(spark, sf):
    return g.more_statistics(views.customer_graph(spark, sf)).select("leaves", *(_r(c) for c in ("density", "transitivity", "in_triangles", "largest_share")))


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT id, 1.0 AS hub FROM nodes)"]
    for i in range(rounds):
        steps.append(
            f"a{i} AS (SELECT nodes.id, coalesce(s, 0) AS v FROM nodes LEFT JOIN (SELECT dst AS id, sum(hub) AS s FROM edges JOIN h{i} ON h{i}.id = src GROUP BY 1) q USING (id)), b{i} AS (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM a{i}) AS authority FROM a{i}), "
            f"u{i} AS (SELECT nodes.id, coalesce(s, 0) AS v FROM nodes LEFT JOIN (SELECT src AS id, sum(authority) AS s FROM edges JOIN b{i} ON b{i}.id = dst GROUP BY 1) q USING (id)), h{i + 1} AS (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM u{i}) AS hub FROM u{i})"
        )
    return f"WITH {_CUST}, nodes AS (SELECT DISTINCT src AS id FROM adj), {', '.join(steps)} SELECT id, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h{rounds} JOIN b{rounds - 1} USING (id)"


@_query(_hits_sql(3))
def g_hits(spark, sf):
    return g.hits(views.customer_graph(spark, sf), rounds=3).select("id", _r("hub", 9), _r("authority", 9))


def _eigen_sql(rounds: int) -> str:
    steps = ["v0 AS (SELECT DISTINCT src AS id, 1.0 AS v FROM adj)"]
    for i in range(rounds):
        steps.append(f"w{i} AS (SELECT src AS id, sum(v) AS v FROM adj JOIN v{i} ON v{i}.id = dst GROUP BY 1), v{i + 1} AS (SELECT id, v / (SELECT sqrt(sum(v * v)) FROM w{i}) AS v FROM w{i})")
    return f"WITH {_CUST}, {', '.join(steps)} SELECT id, round(v, 9) AS value FROM v{rounds}"


@_query(_eigen_sql(8))
def g_eigenvector(spark, sf):
    return g.eigenvector_centrality(views.customer_graph(spark, sf), rounds=8, tolerance=0.0).select("id", _r("value", 9))


def _labels_sql(rounds: int) -> str:
    steps = ["l0 AS (SELECT DISTINCT src AS id, src AS c FROM adj)"]
    for i in range(rounds):
        steps.append(f"n{i} AS (SELECT adj.src AS id, c, count(*) AS n FROM adj JOIN l{i} ON l{i}.id = adj.dst GROUP BY 1, 2), l{i + 1} AS (SELECT id, arg_max(c, (n, -c)) AS c FROM n{i} GROUP BY id)")
    return f"WITH {_CUST}, {', '.join(steps)} SELECT id, c AS community FROM l{rounds}"


@_query(_labels_sql(4))
def g_label_communities(spark, sf):
    return g.label_communities(views.customer_graph(spark, sf), rounds=4)


def _personal_sql(rounds: int) -> str:
    steps = ["p0 AS (SELECT id, h AS r FROM home)"]
    for i in range(rounds):
        steps.append(
            f"t{i} AS (SELECT home.id, h, coalesce(s, 0) AS t FROM home LEFT JOIN (SELECT arcs.dst AS id, sum(0.85 * r * share) AS s FROM arcs JOIN p{i} ON p{i}.id = arcs.src GROUP BY 1) q USING (id)), p{i + 1} AS (SELECT id, t + (1 - (SELECT sum(t) FROM t{i})) * h AS r FROM t{i})"
        )
    return (
        f"WITH {_CUST}, raw AS (SELECT src, dst, 1.0 + src % 3 AS w FROM adj), arcs AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM raw), home AS (SELECT DISTINCT src AS id, CASE WHEN src BETWEEN 9 AND 11 THEN 1.0 / 3 ELSE 0 END AS h FROM adj), "
        + f"{', '.join(steps)} SELECT id, round(r, 9) AS rank FROM p{rounds}"
    )


@_query(_personal_sql(5).replace("raw AS (SELECT src, dst, 1.0", "weighed AS (SELECT src, dst, 1.0").replace("FROM raw), home", "FROM weighed), home"))
def g_personal_ranks(spark, sf):
    e = views.customer_graph(spark, sf)
    arcs = g.both_ways(e).withColumn("weight", F.lit(1.0) + F.col("src") % 3)
    return nw.weighted_page_rank(arcs, g.nodes_of(e), spark.range(9, 12), rounds=5).select("id", _r("rank", 9))


@_query()
def g_edge_betweenness(spark, sf):
    e = views.customer_graph(spark, sf)  # shortest paths from the nodes whose id is divisible by 50, over the whole graph
    return g.edge_betweenness(e, g.nodes_of(e).where("id % 50 = 0")).select("src", "dst", _r("betweenness"))


@_query(
    f"""WITH RECURSIVE {_CUST}, q(v, a, id) AS (SELECT src, dst, dst FROM adj UNION SELECT q.v, q.a, adj.dst FROM q JOIN adj ON adj.src = q.id WHERE adj.dst <> q.v),
    piece AS (SELECT v, a, v * 1000000 + min(id) AS p FROM q GROUP BY v, a), link AS (SELECT x.p, y.p AS o FROM piece x JOIN piece y ON x.v = y.a AND x.a = y.v),
    c(p, m) AS (SELECT p, p FROM link UNION SELECT link.o, c.m FROM c JOIN link ON link.p = c.p WHERE c.m < link.o), own AS (SELECT p // 1000000 AS v, min(m) AS block FROM c GROUP BY p)
    SELECT nodes, count(*) AS blocks FROM (SELECT count(DISTINCT v) AS nodes FROM own GROUP BY block) WHERE nodes > 2 GROUP BY nodes"""
)
def g_biconnected_sizes(spark, sf):
    return cuts.biconnected_sizes(views.customer_graph(spark, sf))


@_query(
    _BRIDGES + """, solid AS (SELECT src, dst FROM adj WHERE (least(src, dst), greatest(src, dst)) NOT IN (SELECT (src, dst) FROM bridge)),
    c(id, m) AS (SELECT src, src FROM solid UNION SELECT solid.dst, c.m FROM c JOIN solid ON solid.src = c.id WHERE c.m < solid.dst), own AS (SELECT id, min(m) AS m FROM c GROUP BY id)
    SELECT nodes, count(*) AS components FROM (SELECT count(*) AS nodes FROM own GROUP BY m) GROUP BY nodes"""
)
def g_without_bridges(spark, sf):
    return cuts.without_bridges(views.customer_graph(spark, sf))


@_query()
def g_covering_group(spark, sf):
    return nw.covering_group(views.copurchase(spark, sf, 2), 5)


@_query()
def g_weighted_closeness(spark, sf):
    e = views.customer_graph(spark, sf)
    arcs = g.both_ways(e).withColumn("weight", 1.0 + (F.col("src") + F.col("dst")) % 4)
    return nw.weighted_closeness(g.weighted_distances(arcs, spark.range(9, 12)), g.nodes_of(e).count()).select("source", _r("farness"), _r("closeness"))


@_query(f"WITH {_CUST}, deg AS (SELECT src AS id, count(*) AS d FROM adj GROUP BY src) SELECT id, d AS degree FROM deg")
def gen_rewired(spark, sf):
    return g.degrees(g.rewired(views.customer_graph(spark, sf), 2, 5))


@_query(
    """WITH n AS (SELECT i FROM range(125) t(i)) SELECT i AS src, i + s AS dst FROM n, range(1, 5) q(s) WHERE i % 5 + s < 5
    UNION ALL SELECT i - i % 25, i FROM n WHERE i % 5 <> 0 AND i // 5 % 5 <> 0 UNION ALL SELECT CAST(0 AS BIGINT), i FROM n WHERE i % 5 <> 0 AND i // 5 % 5 <> 0 AND i // 25 <> 0"""
)
def gen_hierarchical(spark, sf):
    return g.hierarchical(spark, 3)


@_query()
def gen_bipartite(spark, sf):
    return g.bipartite(spark, 100, 300, 2000, 7)


@_query()
def gen_regular(spark, sf):
    return g.regular(spark, 400, 6, 7)


@_query()
def gen_power_law(spark, sf):
    return g.power_law(spark, 1000, 2.3, 100, 7)


# Features, metrics


@_query(
    f"""WITH {_STATE}, one AS (SELECT e2.src AS id, {_means(1)} FROM e2 JOIN f ON f.id = e2.dst GROUP BY 1), two AS (SELECT DISTINCT a.src, b.dst FROM e2 a JOIN e2 b ON a.dst = b.src WHERE NOT EXISTS (SELECT 1 FROM e2 x WHERE x.src = a.src AND x.dst = b.dst)),
    second AS (SELECT two.src AS id, {_means(2)} FROM two JOIN f ON f.id = two.dst GROUP BY 1), t AS (SELECT p_partkey AS id, p_type AS t FROM part),
    near AS (SELECT e2.src AS id, avg(CASE WHEN t = 'ECONOMY' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN t = 'PROMO' THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN t NOT IN ('ECONOMY', 'PROMO') THEN 1.0 ELSE 0.0 END) AS c FROM e2 JOIN crawled ON crawled.id = e2.dst JOIN t ON t.id = e2.dst GROUP BY 1)
    SELECT f.id, {", ".join(f"round({c}, 6) AS {c}" for c in ft.FEATURES)}, od1, cc1, cnf1, tnf1, coalesce(od2, 0) AS od2, coalesce(cc2, 0) AS cc2, coalesce(cnf2, 0) AS cnf2, coalesce(tnf2, 0) AS tnf2, round(1 / log2(101), 6) AS ix,
    CAST(k.id IS NOT NULL AND t.t = 'ECONOMY' AS DOUBLE) AS economy, CAST(k.id IS NOT NULL AND t.t = 'PROMO' AS DOUBLE) AS promo, CAST(k.id IS NOT NULL AND t.t NOT IN ('ECONOMY', 'PROMO') AS DOUBLE) AS undef,
    round(coalesce(a, 0), 6) AS economy1, round(coalesce(b, 0), 6) AS promo1, round(coalesce(c, 0), 6) AS undef1
    FROM f JOIN one USING (id) LEFT JOIN second USING (id) JOIN t USING (id) LEFT JOIN crawled k ON k.id = f.id LEFT JOIN near ON near.id = f.id"""
)
def f_layout(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type")
    names, out = ft.feature_vector(*_state(spark, sf), n_crawled=100, nodes=nodes, attributes={"p_type": ["ECONOMY", "PROMO"]})
    short = {"p_type=ECONOMY": "economy", "p_type=PROMO": "promo", "p_type_is_undef": "undef", "p_type=ECONOMY1": "economy1", "p_type=PROMO1": "promo1", "p_type_is_undef1": "undef1"}
    return out.select("id", *(_round(F.element_at("features", i + 1), 6).alias(short.get(n, n)) for i, n in enumerate(names)))


_VISIBLE = "adj2 AS (SELECT DISTINCT p_partkey AS src, p_partkey % 17 + 1 AS dst FROM part UNION SELECT DISTINCT p_partkey % 17 + 1, p_partkey FROM part)"


@_query(
    _LOG
    + f""", {_VISIBLE}, small AS (SELECT run_id, step, node FROM log), first AS (SELECT run_id, node, min(step) AS step FROM small GROUP BY 1, 2), seen AS (SELECT run_id, dst AS node, min(step) AS step FROM first JOIN adj2 ON src = node GROUP BY 1, 2),
    k AS (SELECT run_id, node FROM first UNION SELECT run_id, node FROM seen), all_ AS (SELECT k.run_id, k.node, f.step AS c, s.step AS s, coalesce(y, 0) AS y FROM k LEFT JOIN first f USING (run_id, node) LEFT JOIN seen s USING (run_id, node) LEFT JOIN lab ON lab.id = k.node),
    g AS (SELECT DISTINCT run_id, step FROM first), p AS (SELECT g.run_id, g.step, part, sum(CASE part WHEN 'crawled' THEN CAST(c <= g.step AS INT) WHEN 'observed' THEN CAST(s <= g.step AND (c IS NULL OR c > g.step) AS INT) ELSE CAST(coalesce(c <= g.step, false) OR coalesce(s <= g.step, false) AS INT) END) AS size,
    sum(y * CASE part WHEN 'crawled' THEN CAST(c <= g.step AS INT) WHEN 'observed' THEN CAST(s <= g.step AND (c IS NULL OR c > g.step) AS INT) ELSE CAST(coalesce(c <= g.step, false) OR coalesce(s <= g.step, false) AS INT) END) AS hits
    FROM g JOIN all_ USING (run_id), (VALUES ('crawled'), ('observed'), ('nodes')) v(part) GROUP BY 1, 2, 3)
    SELECT run_id, step, part, CAST(coalesce(size, 0) AS BIGINT) AS size, CAST(coalesce(hits, 0) AS BIGINT) AS hits, round(coalesce(hits, 0) / CAST(nullif(size, 0) AS DOUBLE), 6) AS precision, round(coalesce(hits, 0) / CAST(t AS DOUBLE), 6) AS recall, round(2.0 * coalesce(hits, 0) / (t + coalesce(size, 0)), 6) AS f1 FROM p, t"""
)
def m_parts(spark, sf):
    log = _log(spark, sf).groupBy("run_id", "node").agg(F.min("step").alias("step"))
    part = table(spark, sf, "part")
    adj = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 17 + 1).alias("dst"))
    adj = adj.unionByName(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    lab = views.part_labels(spark, sf)
    total = lab.agg(F.sum("y").alias("t"))
    found = ev.part_scores(ev.parts_by_step(log, adj, lab).crossJoin(F.broadcast(total)), F.col("t"))
    return found.select("run_id", F.col("step").cast("long").alias("step"), "part", "size", "hits", _r("precision"), _r("recall"), _r("f1"))


@_query(_HIST + "SELECT graph, crawler, instance, step, value FROM h WHERE instance < 2 UNION ALL SELECT graph, crawler, 2, step, value FROM h WHERE instance = 2")
def e_merged(spark, sf):
    h = views.histories(spark, sf)
    one, two = h.where("instance < 2"), h.where("instance >= 1").withColumn("instance", F.col("instance") - 1)
    out = ev.merged([one, two], ["graph", "crawler"])
    return out.select("graph", "crawler", F.col("instance").cast("int").alias("instance"), "step", "value")


@_query("SELECT title, budget FROM (VALUES ('donors', 100), ('livejournal', 1200), ('dblp', 1200), ('kickstarter', 700)) v(title, budget)")
def d_presets(spark, sf):
    rows = [(p.title, p.budget) for p in presets.PRESETS if p.graph[0] in ("sel_harv", "snap")]
    return spark.createDataFrame(rows, "title string, budget int")


# Communities

_LINES = """WITH n AS (SELECT DISTINCT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS o FROM lineitem), big AS (SELECT o, min(id) AS least FROM n GROUP BY o HAVING count(*) > 1)
    SELECT id, least AS community FROM n JOIN big USING (o)"""


def _order_parts(spark, sf):
    """Parts of an order, linked with each other: the best communities are the orders, by any score."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("id"))
    n = lines.repartition(tb.tasks(spark, lines.count()), "o").distinct()
    return n.select("o", F.col("id").alias("src")).join(n.select("o", F.col("id").alias("dst")), "o").where("src < dst").select("src", "dst")


@_query(_LINES)
def g_communities(spark, sf):
    return cm.multilevel(_order_parts(spark, sf), cm.MODULARITY)[0]


@_query(_LINES)
def g_modules(spark, sf):
    return cm.multilevel(_order_parts(spark, sf), cm.MAP_EQUATION)[0]


@_query()
def g_community_levels(spark, sf):
    levels = cm.multilevel(views.copurchase(spark, sf, 2), cm.MODULARITY)[1]
    return spark.createDataFrame(levels, "level int, communities long, modularity double")


@_query(
    f"""WITH {_COP}, s AS (SELECT count(*) AS s FROM adj), l AS (SELECT p_partkey AS id, p_brand AS c FROM part), x AS (SELECT a.c AS c, a.c <> b.c AS out FROM adj JOIN l a ON a.id = src JOIN l b ON b.id = dst),
    g AS (SELECT count(*) / s AS total, count(*) FILTER (out) / s AS cut FROM x, s GROUP BY c, s), q AS (SELECT sum(cut) AS q FROM g)
    SELECT round((SELECT CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END FROM q) + (SELECT sum((cut + total) * log2(cut + total) - 2 * CASE WHEN cut > 0 THEN cut * log2(cut) ELSE 0 END) FROM g) - (SELECT sum(d / s * log2(d / s)) FROM deg, s), 6) AS code_length"""
)
def g_code_length(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    return cm.code_length(views.copurchase(spark, sf, 2), brands).select(_r("code_length"))
