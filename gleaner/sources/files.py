"""Edge lists, adjacency lists, attribute files and tables of values, read and written by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.graph import edges_from
from gleaner.operators.table import row_numbers


def _lines(spark: SparkSession, path: str, ignore: str = "#%") -> DataFrame:
    text = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))
    return text.where((F.col("value") != "") & ~F.substring("value", 1, 1).isin(list(ignore)))


def _fields(separator: str | None) -> Column:
    return F.split("value", r"\s+" if separator is None else "\\Q" + separator + "\\E")


def edge_list(spark: SparkSession, path: str, source: int = 0, target: int = 1, separator: str | None = None) -> DataFrame:
    """Distinct undirected edges of a text file; comment lines, lines that don't hold two integers, and loops are skipped."""
    f = _fields(separator)
    rows = _lines(spark, path).select(F.expr("1").alias("one"), f.alias("f")).select(*(F.get("f", F.lit(i)).try_cast("long").alias(n) for n, i in (("a", source), ("b", target))))
    return edges_from(rows.dropna(), "a", "b")


def edge_list_named(spark: SparkSession, path: str, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, numbers) of a file with names for nodes: numbers(name, number) are dense, in the order names are first seen."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    rows = rows.where((F.trim("value") != "") & ~F.substring(F.trim("value"), 1, 1).isin("#", "%")).select("line", _fields(separator).alias("f"))
    rows = rows.select("line", F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b")).dropna()
    seen = rows.select(F.explode(F.array(F.struct(F.col("a").alias("name"), (F.col("line") * 2).alias("at")), F.struct(F.col("b").alias("name"), (F.col("line") * 2 + 1).alias("at")))).alias("s"))
    numbers = row_numbers(seen.groupBy("s.name").agg(F.min("s.at").alias("at")), ["at"], "number").select("name", "number")
    a, b = numbers.select(F.col("name").alias("a"), F.col("number").alias("x")), numbers.select(F.col("name").alias("b"), F.col("number").alias("y"))
    return edges_from(rows.join(a, "a").join(b, "b"), "x", "y"), numbers


def raw_edge_list(spark: SparkSession, path: str, ignore: str = "#%", columns: str = "ij", self_loops: bool = False, renumber: bool = False) -> DataFrame:
    """Edges (src, dst) of a raw file: fields i, j and perhaps weight and time between blanks, tabs or commas, in the order `columns` names.

    self_loops keeps loops. renumber: nodes get dense numbers in the order they are first seen, i before j in a line.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    rows = rows.where((F.trim("value") != "") & ~F.substring("value", 1, 1).isin(list(ignore)))
    f = F.filter(F.split("value", r"[ \t,]"), lambda x: x != "")
    rows = rows.select("line", f.alias("f")).select("line", *(F.get("f", F.lit(columns.index(c))).alias(n) for c, n in (("i", "a"), ("j", "b"))))
    if not self_loops:
        rows = rows.where("a <> b")
    if not renumber:
        return rows.select(F.col("a").try_cast("long").alias("src"), F.col("b").try_cast("long").alias("dst")).dropna()
    seen = rows.select(F.explode(F.array(F.struct(F.col("a").alias("name"), (F.col("line") * 2).alias("at")), F.struct(F.col("b").alias("name"), (F.col("line") * 2 + 1).alias("at")))).alias("s"))
    numbers = row_numbers(seen.groupBy("s.name").agg(F.min("s.at").alias("at")), ["at"], "n").select("name", "n")
    a, b = numbers.select(F.col("name").alias("a"), F.col("n").alias("src")), numbers.select(F.col("name").alias("b"), F.col("n").alias("dst"))
    return rows.join(a, "a").join(b, "b").select("src", "dst")


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """Edges of lines that hold a node and then its neighbours."""
    f = F.transform(_fields(None), lambda x: x.try_cast("long"))
    rows = _lines(spark, path).select(f.alias("f")).select(F.get("f", F.lit(0)).alias("a"), F.explode(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0)))).alias("b"))
    return edges_from(rows.dropna(), "a", "b")


def pajek(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label), edges(src, dst, directed)) of a file with *Vertices, *Arcs and *Edges sections."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    lines = lines.select("line", F.trim("value").alias("value")).where("value <> '' and value not like '\\%%'")
    heads = F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col("value").startswith("*"), F.struct("line", F.lower(F.regexp_extract("value", r"^\*(\w+)", 1)).alias("kind"))))), F.array().cast("array<struct<line:int,kind:string>>"), lambda acc, x: F.concat(acc, F.array(x))
    )
    sections = lines.where(F.col("value").startswith("*")).agg(heads.alias("heads"))  # a few section lines a file
    tagged = lines.where(~F.col("value").startswith("*")).crossJoin(F.broadcast(sections))
    kind = F.element_at(F.filter("heads", lambda h: h["line"] < F.col("line")), -1)["kind"]
    f = F.split("value", r"\s+")
    rows = tagged.select(kind.alias("kind"), "value", f.alias("f"))
    vertices = rows.where("kind = 'vertices'").select(F.get("f", F.lit(0)).try_cast("long").alias("id"), F.regexp_extract("value", r'^\S+\s+"?([^"]*)"?', 1).alias("label"))
    edges = rows.where("kind in ('arcs', 'edges')").select(F.get("f", F.lit(0)).try_cast("long").alias("src"), F.get("f", F.lit(1)).try_cast("long").alias("dst"), (F.col("kind") == "arcs").alias("directed"))
    return vertices, edges.dropna()


def adjacency_list_named(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, numbers) of lines that hold a node's name and then its neighbours' names, numbered as edge_list_named does."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where((F.col("value") != "") & ~F.substring("value", 1, 1).isin("#", "%")).select("line", F.posexplode(F.split("value", r"\s+")).alias("at", "name"))
    first = lines.groupBy("name").agg(F.min(F.struct("line", "at")).alias("seen")).select("name", "seen.line", "seen.at")
    numbers = row_numbers(first, ["line", "at"], "number").select("name", "number")
    placed = lines.join(numbers, "name")
    heads = placed.where("at = 0").select("line", F.col("number").alias("a"))
    return edges_from(placed.where("at > 0").select("line", F.col("number").alias("b")).join(heads, "line"), "a", "b"), numbers


def edge_list_with(spark: SparkSession, path: str, columns: str, separator: str | None = None) -> DataFrame:
    """Rows of an edge list with attributes: columns is DDL such as "src long, dst long, weight double"; a field that doesn't parse is null, and rows without both ends go."""
    schema = T.StructType.fromDDL(columns)
    rows = _lines(spark, path).select(F.expr("1").alias("one"), _fields(separator).alias("f"))
    rows = rows.select(*(F.get("f", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))
    return rows.dropna(subset=schema.names[:2])


def write_edge_list(edges: DataFrame, path: str, separator: str = " ", description: str | None = None, attributes: Sequence[str] = ()) -> None:
    """Lines of src, dst and attributes; with a description, comment lines with it, the numbers of nodes and edges and the columns come first."""
    names = ["src", "dst", *attributes]
    lines = edges.select(F.concat_ws(separator, *(F.col(n).cast("string") for n in names)).alias("value"))
    if description is not None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("n"), F.count("*").alias("m"))
        size = ends.select(F.concat(F.lit("# Nodes: "), F.col("n"), F.lit(" Edges: "), (F.col("m") / 2).cast("long")).alias("size"))
        head = size.select(F.explode(F.array(F.lit(f"# {description}"), "size", F.lit(f"# {separator.join(names)}"))).alias("value"))
        lines = head.coalesce(1).unionByName(lines)
    lines.write.mode("overwrite").text(path)


def write_benchmark(edges: DataFrame, communities: DataFrame, path: str) -> None:
    """A benchmark graph's two files: network (both directions) and community (a node and all its communities), numbered from 1, with tabs."""
    arcs = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    arcs.select(F.concat_ws("\t", F.col("e.src") + 1, F.col("e.dst") + 1)).write.mode("overwrite").text(f"{path}/network")
    own = communities.groupBy("id").agg(F.sort_array(F.collect_set(F.col("community") + 1)).alias("c"))
    own.select(F.concat_ws("\t", F.col("id") + 1, F.array_join(F.transform("c", lambda x: x.cast("string")), " "))).write.mode("overwrite").text(f"{path}/community")


def dense_arcs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, numbers) for graph libraries: both directions of each edge under dense numbers from 0 in the order of ids."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    numbers = row_numbers(ends, ["id"], "number")
    a, b = numbers.select(F.col("id").alias("src"), F.col("number").alias("s")), numbers.select(F.col("id").alias("dst"), F.col("number").alias("d"))
    both = edges.join(a, "src").join(b, "dst")
    return both.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("d").alias("dst")), F.struct(F.col("d").alias("src"), F.col("s").alias("dst")))).alias("e")).select("e.src", "e.dst"), numbers


def to_networkx(edges: DataFrame, attributes: DataFrame | None = None, most: int = 10_000_000):
    """A networkx graph on the driver, of at most `most` edges, with the columns of attributes(id, ...) on its nodes; needs the networkx package."""
    import networkx

    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} edges")
    out = networkx.Graph()
    out.add_edges_from((r["src"], r["dst"]) for r in edges.select("src", "dst").toLocalIterator())
    for r in attributes.toLocalIterator() if attributes is not None else ():
        out.add_node(r["id"], **{k: v for k, v in r.asDict().items() if k != "id"})
    return out


def attribute(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (id, value) of a JSON object {node: value}, or of several in a file; value is JSON text, or what the key path leads to (null where it leads nowhere)."""
    text = F.regexp_replace("value", r"\}\s*\n\s*\{", ",")  # stands between objects only
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,variant>")).alias("id", "v"))
    value = F.try_variant_get("v", "$" + "".join(f"['{k}']" for k in keys), "string") if keys else F.to_json("v")
    return whole.select(F.col("id").try_cast("long").alias("id"), value.alias("value"))


def write_attribute(values: DataFrame, path: str) -> None:
    """JSON objects {node: value}, one a line, from rows (id, value)."""
    values.select(F.to_json(F.create_map(F.col("id").cast("string"), F.col("value")))).write.mode("overwrite").text(path)


def infer_schema(spark: SparkSession, path: str, separator: str = "\t", peek: int = 1000) -> T.StructType:
    """Column types (int, double or string) by the first rows; names from the last comment line, if there is one."""
    head = [r["value"] for r in spark.read.text(path).limit(peek).collect()]
    comments = [x.lstrip("# ").split(separator) for x in head if x.startswith("#")]
    rows = [x.split(separator) for x in head if x and not x.startswith("#")]
    width = max(map(len, rows), default=0)

    def kind(values: list[str]) -> T.DataType:
        for cast, t in ((int, T.LongType()), (float, T.DoubleType())):
            try:
                for v in values:
                    cast(v)
            except ValueError:
                continue
            return t
        return T.StringType()

    names = comments[-1] if comments and len(comments[-1]) == width else [f"c{i}" for i in range(width)]
    return T.StructType([T.StructField(n, kind([r[i] for r in rows if len(r) > i])) for i, n in enumerate(names)])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None, separator: str = "\t", header: bool = False) -> DataFrame:
    """A delimited table; comment lines are skipped, and only the named columns are parsed."""
    df = spark.read.schema(schema or infer_schema(spark, path, separator)).csv(path, sep=separator, header=header, comment="#")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=separator, header=True)


def dump(df: DataFrame, path: str, separator: str = "\t") -> None:
    """A table as text: a comment line with the names, then rows, floats with six digits."""
    shown = [F.format_string("%f", F.col(f"`{f.name}`").cast("double")) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    head = df.sparkSession.range(1, numPartitions=1).select(F.lit("# " + separator.join(df.columns)).alias("value"))
    head.unionByName(df.select(F.concat_ws(separator, *(F.coalesce(c, F.lit("")) for c in shown)).alias("value"))).write.mode("overwrite").text(path)


def save(df: DataFrame, path: str) -> None:
    """A table in binary columns (Parquet)."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """df and some literal rows of its columns."""
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def append_column(df: DataFrame, order: Sequence[str], values: DataFrame, value: str, value_order: Sequence[str], name: str) -> DataFrame:
    """df with a column whose values match its rows by position; a row beyond the values gets null."""
    own = row_numbers(values.select(value, *(c for c in value_order if c != value)), value_order, "__pos").select("__pos", F.col(value).alias(name))
    return row_numbers(df, order, "__pos").join(own, "__pos", "left").drop("__pos")


def read_column(df: DataFrame, column: str, order: Sequence[str]):
    """The values of a column in order, one partition after another, as an iterator on the driver."""
    return (r[0] for r in df.orderBy(*order).select(column).toLocalIterator())


def from_map(spark: SparkSession, values: dict, key: str = "key", value: str = "value") -> DataFrame:
    """Two columns from a map."""
    return spark.createDataFrame(list(values.items()), [key, value])
