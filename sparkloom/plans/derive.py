"""A code graph derived from the star-schema tables, as SQL that both engines run unchanged.

Parts are files; consecutive high-quantity lines of an order are edges between them; lines of the highest quantities
are symbols, with an edge to the nation of their supplier as an external package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .graph import CodeGraph

TABLES = ("part", "lineitem", "supplier", "nation", "events", "documents", "pages", "labels", "orders", "customer")

#: Each may use the tables and the views before it, in braces.
VIEWS = {
    "pg_files": """
SELECT p_partkey AS part,
       concat(replace(p_brand,'#','-'),'/p',cast(p_partkey AS varchar(20)),'.src') AS path,
       concat('file:',replace(p_brand,'#','-'),'/p',cast(p_partkey AS varchar(20)),'.src') AS id,
       CASE p_size % 4 WHEN 0 THEN 'ts' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' ELSE 'cpp' END AS language,
       p_size
FROM {part}""",
    "pg_steps": """
SELECT * FROM (
  SELECT l_partkey AS p, l_suppkey AS s, l_linenumber AS line, l_returnflag AS flag, l_quantity AS q,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,
           l_extendedprice,l_returnflag,l_quantity,l_discount,l_tax,l_shipdate) AS n
  FROM {lineitem} WHERE l_quantity >= 42) t WHERE n IS NOT NULL""",
    "pg_symbols": """
SELECT DISTINCT f.part, t.s, f.path, concat('sym:',f.path,'#s',cast(t.s AS varchar(20))) AS id, f.language
FROM {pg_steps} t JOIN {pg_files} f ON t.p = f.part WHERE t.q >= 49""",
    "pg_edges": """
SELECT src, dst, kind, min(line) AS line FROM (
  SELECT a.id AS src, b.id AS dst, CASE WHEN t.flag='R' THEN 'reference' ELSE 'import' END AS kind, t.line
    FROM {pg_steps} t JOIN {pg_files} a ON t.p=a.part JOIN {pg_files} b ON t.n=b.part WHERE t.q < 49
  UNION ALL
  SELECT y.id, b.id, 'reference', t.line
    FROM {pg_steps} t JOIN {pg_symbols} y ON y.part=t.p AND y.s=t.s JOIN {pg_files} b ON t.n=b.part WHERE t.q >= 49
  UNION ALL
  SELECT y.id, concat('ext:nation:',n.n_name), 'reference', cast(1 AS int)
    FROM {pg_symbols} y JOIN {supplier} u ON u.s_suppkey=y.s JOIN {nation} n ON n.n_nationkey=u.s_nationkey
) x GROUP BY src, dst, kind""",
    "pg_nodes": """
SELECT id,'file' AS kind,language,path AS name,cast(NULL AS varchar(10)) AS file FROM {pg_files}
UNION ALL SELECT id,'symbol',language,concat('s',cast(s AS varchar(20))),path FROM {pg_symbols}
UNION ALL SELECT DISTINCT dst,'external',cast(NULL AS varchar(10)),substr(dst,5),cast(NULL AS varchar(10))
          FROM {pg_edges} WHERE dst LIKE 'ext:%'""",
}

_PLAIN = {n: n for n in (*TABLES, *VIEWS)}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause, without a final comma, that defines the views up to the last named one."""
    order = list(VIEWS)
    last = max(order.index(n) for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({VIEWS[n].format(**_PLAIN)})" for n in order[: last + 1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables and views by name."""
    frames: dict[str, DataFrame] = {n: table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier", "nation")}
    for name, sql in VIEWS.items():
        frames[name] = spark.sql(sql, **{n: f for n, f in frames.items() if f"{{{n}}}" in sql})
    return frames


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    from pyspark.sql import functions as F

    v = views(spark, sf_dir)
    nodes = v["pg_nodes"].withColumn("owner_file", F.when(F.col("kind") == "file", F.col("name")).otherwise(F.col("file")))
    owner = F.when(F.col("src").startswith("file:"), F.substring("src", 6, 1 << 30)).otherwise(F.substring_index(F.substring("src", 5, 1 << 30), "#", 1))
    edges = v["pg_edges"].select("*", F.struct(F.col("line"), F.lit(None).cast("int").alias("col")).alias("loc"), owner.alias("owner_file"))
    edges = edges.withColumn("target_type", F.when(F.col("dst").startswith("file:"), "file").when(F.col("dst").startswith("sym:"), "symbol").otherwise("external")).withColumn("resolution", F.lit("resolved"))
    return CodeGraph.of(nodes, edges)
