"""Every operator of the graph engine as a query over the test tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import cycles, explore, overlay, paths, resolve, tools, traverse
from ..sources import control, ingest
from ..streaming import changes
from . import derive, storage
from .derive import table, with_views
from .graph import CodeGraph, conform, EDGE, NODE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def graph_query(sql: str | None = None):
    """A query that takes the derived graph."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(derive.graph(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


V = with_views("pg_nodes")
#: The file that most edges point to, as a scalar subquery; and the whole graph as links.
HUB_SQL = "(SELECT dst FROM pg_edges WHERE dst LIKE 'file:%' GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def hub(graph: CodeGraph) -> str:
    into = graph.edges.where(F.col("dst").startswith("file:")).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return into.orderBy(F.desc("n"), "dst").first().dst


# ---- identifiers and scalar functions


@query(V + """
SELECT y.path, concat('file:', replace(y.path, '\\', '/')) AS file, y.id AS symbol, concat(y.id, '~', cast(y.s % 3 + 1 AS varchar)) AS again,
       concat('ext:', n.n_name) AS external, concat('ext:', y.language, ':', n.n_name) AS named
FROM pg_symbols y JOIN supplier u ON u.s_suppkey = y.s JOIN nation n ON n.n_nationkey = u.s_nationkey""")
def node_ids(spark, sf_dir):
    v = derive.views(spark, sf_dir)
    s = v["pg_symbols"].join(v["supplier"], F.col("s_suppkey") == F.col("s")).join(v["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
    path, name = F.col("path"), F.concat(F.lit("s"), F.col("s").cast("string"))
    return s.select(
        "path", ids.file_id(path).alias("file"), ids.symbol_id(path, name).alias("symbol"), ids.symbol_id(path, name, (F.col("s") % 3 + 1).cast("int")).alias("again"),
        ids.external_id(F.col("n_name")).alias("external"), ids.external_id(F.col("n_name"), F.col("language")).alias("named"),
    )


@query("""
SELECT concat('sym:p', cast(l_partkey AS varchar), '#s', cast(l_suppkey % 5 AS varchar), CASE WHEN n > 0 THEN concat('~', cast(n AS varchar)) ELSE '' END) AS id
FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 5 ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem)""")
def symbol_collision_suffix(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("name", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")))  # noqa: E741
    n = ids.collision_number("l_partkey", "name", order=["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"])
    l = l.withColumn("n", n)  # noqa: E741
    return l.select(ids.symbol_id(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.col("name"), F.col("n")).alias("id"))


@graph_query(V + " SELECT CASE WHEN id LIKE 'file:%' THEN 'file' WHEN id LIKE 'sym:%' THEN 'symbol' ELSE 'external' END AS kind, count(*) AS n FROM pg_nodes GROUP BY 1")
def node_kind_counts(graph):
    return graph.nodes.groupBy(ids.node_kind(F.col("id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@graph_query(V + """
SELECT id, CASE WHEN id LIKE 'sym:%' THEN concat('file:', substr(id, 5, strpos(id, '#') - 5)) END AS container,
       CASE WHEN id LIKE 'file:%' THEN substr(id, 6) WHEN id LIKE 'sym:%' THEN substr(id, 5, strpos(id, '#') - 5) END AS path,
       CASE WHEN id LIKE 'sym:%' THEN substr(id, strpos(id, '#') + 1) END AS symbol
FROM pg_nodes""")
def containing_file(graph):
    i = F.col("id")
    return graph.nodes.select("id", ids.containing_file(i).alias("container"), ids.file_path(i).alias("path"), ids.symbol_name(i).alias("symbol"))


@graph_query(V + """
SELECT id, CASE WHEN id LIKE 'file:%' THEN regexp_extract(substr(id, 6), '[^/]*$') WHEN id LIKE 'sym:%' THEN substr(id, strpos(id, '#') + 1) ELSE substr(id, 5) END AS label FROM pg_nodes""")
def display_name(graph):
    return graph.nodes.select("id", ids.display_name(F.col("id")).alias("label"))


@graph_query(V + """
SELECT id, CASE WHEN id LIKE 'file:%' THEN 'file' WHEN id LIKE 'sym:%' THEN 'sym' ELSE 'ext' END AS parsed,
       CASE WHEN id LIKE 'file:%' THEN substr(id, 6) WHEN id LIKE 'sym:%' THEN substr(id, 5, strpos(id, '#') - 5) END AS path,
       CASE WHEN id LIKE 'sym:%' THEN substr(id, strpos(id, '#') + 1) END AS name,
       CASE WHEN id LIKE 'ext:%' THEN 'nation' END AS language, CASE WHEN id LIKE 'ext:%' THEN substr(id, 12) END AS specifier
FROM pg_nodes""")
def parse_node_id(graph):
    p = graph.nodes.select("id", ids.parse_node_id(F.col("id")).alias("p"))
    return p.select("id", F.col("p.kind").alias("parsed"), "p.path", "p.name", "p.language", "p.specifier")


@query("""
SELECT target, CASE WHEN target LIKE 'file:%' THEN target END AS node_id,
       CASE WHEN target LIKE 'file:%' THEN NULL WHEN target LIKE '%#%' THEN regexp_extract(target, '^(.+)#([^#]*)$', 1) ELSE target END AS path,
       CASE WHEN target LIKE 'file:%' THEN NULL WHEN target LIKE '%#%' THEN regexp_extract(target, '^(.+)#([^#]*)$', 2) END AS symbol
FROM (SELECT CASE p_size % 3 WHEN 0 THEN concat('file:', p_name) WHEN 1 THEN concat(p_brand, '/x#', p_type) ELSE p_name END AS target FROM part)""")
def parse_target(spark, sf_dir):
    n = F.col("p_size") % 3
    target = F.when(n == 0, F.concat(F.lit("file:"), "p_name")).when(n == 1, F.concat("p_brand", F.lit("/x#"), "p_type")).otherwise(F.col("p_name"))
    t = table(spark, sf_dir, "part").select(target.alias("target"))
    return t.select("target", ids.parse_target(F.col("target")).alias("t")).select("target", "t.*")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("hash"))


GROUP_HASH_SQL = "concat('scc-', printf('%x', list_reduce(list_transform(string_split({0}, ''), lambda c: cast(ascii(c) AS bigint)), lambda h, c: (h * 33 + c) & 4294967295, cast(5381 AS bigint))))"


@query(f"""
WITH g AS (SELECT l_orderkey, string_agg(DISTINCT concat('file:p', cast(l_partkey AS varchar)), '|' ORDER BY concat('file:p', cast(l_partkey AS varchar))) AS joined FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, {GROUP_HASH_SQL.format('joined')} AS id FROM g""")
def cycle_group_hash(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("file:p"), F.col("l_partkey").cast("string")))).alias("all"))
    return g.select("l_orderkey", ids.group_hash(F.col("all")).alias("id"))


@query("""
SELECT p_partkey, replace(replace(rtrim(to_base64(encode(cast(p_partkey AS varchar))), '='), '+', '-'), '/', '_') AS cursor, p_partkey AS back,
       CASE WHEN regexp_matches(p_name, '^[0-9]') THEN NULL ELSE 0 END AS bad FROM part""")
def page_cursor(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", ids.encode_cursor(F.col("p_partkey")).alias("cursor"))
    return p.select("p_partkey", "cursor", ids.decode_cursor(F.col("cursor")).alias("back"), ids.decode_cursor(F.lit("!!")).cast("int").alias("bad"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def paginate(spark, sf_dir):
    return explore.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_partkey")], 100, 50)


@query("""
SELECT spec, CASE WHEN spec LIKE '@%' THEN regexp_extract(spec, '^[^/]*(/[^/]*)?') ELSE regexp_extract(spec, '^[^/]*') END AS package,
       regexp_extract(spec, '^@?[^/]*') AS of_path
FROM (SELECT CASE p_size % 3 WHEN 0 THEN concat('@', p_type, '/', p_name, '/x') WHEN 1 THEN concat(p_name, '/lib/', p_type) ELSE p_name END AS spec FROM part)""")
def package_name(spark, sf_dir):
    n = F.col("p_size") % 3
    spec = F.when(n == 0, F.concat(F.lit("@"), "p_type", F.lit("/"), "p_name", F.lit("/x"))).when(n == 1, F.concat("p_name", F.lit("/lib/"), "p_type")).otherwise(F.col("p_name"))
    t = table(spark, sf_dir, "part").select(spec.alias("spec"))
    plain = F.regexp_replace("spec", "^@", "")
    of = ids.package_of_path(F.concat(F.lit("a\\node_modules\\b/node_modules/"), plain))
    return t.select("spec", ids.package_name(F.col("spec")).alias("package"), F.when(F.col("spec").startswith("@"), F.concat(F.lit("@"), of)).otherwise(of).alias("of_path"))


@query("""
SELECT spec, CASE WHEN strpos(spec, '/') > 1 THEN substr(spec, 1, strpos(spec, '/') - 1) ELSE regexp_replace(spec, '\\.h$', '') END AS framework
FROM (SELECT CASE p_size % 3 WHEN 0 THEN concat(p_type, '/', p_name, '.h') WHEN 1 THEN concat(p_name, '.h') ELSE concat('/', p_name) END AS spec FROM part)""")
def framework_name(spark, sf_dir):
    n = F.col("p_size") % 3
    spec = F.when(n == 0, F.concat("p_type", F.lit("/"), "p_name", F.lit(".h"))).when(n == 1, F.concat("p_name", F.lit(".h"))).otherwise(F.concat(F.lit("/"), "p_name"))
    return table(spark, sf_dir, "part").select(spec.alias("spec")).select("spec", ids.framework_name(F.col("spec")).alias("framework"))


_PATHS_SQL = "SELECT user_id, CASE user_id % 6 WHEN 0 THEN concat('a/node_modules/u', cast(user_id AS varchar)) WHEN 1 THEN concat('src\\.git\\u', cast(user_id AS varchar)) WHEN 2 THEN concat('x', cast(user_id AS varchar), '.pyc') WHEN 3 THEN concat('mydist/u', cast(user_id AS varchar)) WHEN 4 THEN concat('my/dist/u', cast(user_id AS varchar)) ELSE concat('src/u', cast(user_id AS varchar), '.ts') END AS path FROM events"


@query(f"SELECT path, regexp_matches(replace(path, '\\', '/'), 'node_modules/|\\.git/|dist/|build/|\\.next/|__pycache__/|\\.pyc|\\.pyo') AS ignored FROM ({_PATHS_SQL})")
def ignored_paths(spark, sf_dir):
    u = F.col("user_id").cast("string")
    n = F.col("user_id") % 6
    path = (
        F.when(n == 0, F.concat(F.lit("a/node_modules/u"), u)).when(n == 1, F.concat(F.lit("src\\.git\\u"), u)).when(n == 2, F.concat(F.lit("x"), u, F.lit(".pyc")))
        .when(n == 3, F.concat(F.lit("mydist/u"), u)).when(n == 4, F.concat(F.lit("my/dist/u"), u)).otherwise(F.concat(F.lit("src/u"), u, F.lit(".ts")))
    )
    return table(spark, sf_dir, "events").select(path.alias("path")).select("path", ids.ignored(F.col("path")).alias("ignored"))


@query("""
SELECT spec, length(spec) - length(ltrim(spec, '.')) AS level, nullif(ltrim(spec, '.'), '') AS submodule
FROM (SELECT concat(repeat('.', p_size % 4), CASE WHEN p_size % 5 = 0 THEN '' ELSE replace(p_name, ' ', '.') END) AS spec FROM part)""")
def relative_import_level(spark, sf_dir):
    spec = F.concat(F.expr("repeat('.', p_size % 4)"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.translate("p_name", " ", ".")))
    return table(spark, sf_dir, "part").select(spec.alias("spec")).select("spec", ids.relative_import(F.col("spec")).alias("r")).select("spec", "r.level", "r.submodule")


@query("""
SELECT path, root, regexp_replace(path, '/$', '') = regexp_replace(root, '/$', '') OR starts_with(regexp_replace(path, '/$', ''), concat(regexp_replace(root, '/$', ''), '/')) AS inside
FROM (SELECT concat('/r/b', cast(p_size % 7 AS varchar), '/p', cast(p_partkey AS varchar)) AS path, concat('/r/b', cast(p_partkey % 7 AS varchar), CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END) AS root FROM part)""")
def path_is_within(spark, sf_dir):
    path = F.expr("concat('/r/b', cast(p_size % 7 AS string), '\\\\p', cast(p_partkey AS string))")
    root = F.expr("concat('/r/b', cast(p_partkey % 7 AS string), CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END)")
    t = table(spark, sf_dir, "part").select(path.alias("p"), root.alias("root"))
    return t.select(ids.slashes(F.col("p")).alias("path"), "root", ids.is_within(F.col("p"), F.col("root")).alias("inside"))


@query("""
SELECT p_partkey, p_size % 4 < 3 AS cpp FROM part""")
def cpp_header_sniff(spark, sf_dir):
    text = F.expr("CASE p_size % 4 WHEN 0 THEN concat('class ', 'A', cast(p_partkey AS string), ';') WHEN 1 THEN 'template <int N> int f();' WHEN 2 THEN 'std::size_t n;' ELSE 'int subclass_of(int operators);' END")
    return table(spark, sf_dir, "part").select("p_partkey", ids.looks_cpp(text).alias("cpp"))


# ---- target resolution


@graph_query(V + " SELECT count(*) AS found, min(id) AS id FROM pg_nodes WHERE id = (SELECT min(id) FROM pg_symbols)")
def resolve_node_id(graph):
    want = graph.nodes.where("kind = 'symbol'").agg(F.min("id")).first()[0]
    r = resolve.resolve(graph, want)
    return graph.spark.createDataFrame([(int(r.found), r.id)], "found long, id string")


@graph_query(V + """,
t AS (SELECT DISTINCT path FROM (SELECT concat('p', cast(part AS varchar), '.src') AS path FROM pg_files UNION ALL SELECT path FROM pg_files WHERE part % 3 = 0 UNION ALL SELECT concat('7/p', cast(part AS varchar), '.src') FROM pg_files)),
h AS (SELECT t.path, f.id, f.path = t.path AS exact FROM t LEFT JOIN pg_files f ON f.path = t.path OR ends_with(f.path, concat('/', t.path)))
SELECT path, CASE WHEN bool_or(exact) THEN concat('file:', path) WHEN count(id) = 1 THEN min(id) END AS id,
       CASE WHEN coalesce(bool_or(exact), false) OR count(id) = 1 THEN '' ELSE coalesce(string_agg(id, ',' ORDER BY id), '') END AS candidates
FROM h GROUP BY path""")
def resolve_path_suffix(graph):
    part = F.regexp_extract("id", r"/p(\d+)\.src$", 1)
    files = graph.nodes.where("kind = 'file'").select("name", part.alias("part"))
    t = files.select(F.concat(F.lit("p"), "part", F.lit(".src")).alias("path"))
    t = t.unionByName(files.where("cast(part AS int) % 3 = 0").select(F.col("name").alias("path"))).unionByName(files.select(F.concat(F.lit("7/p"), "part", F.lit(".src")).alias("path")))
    r = resolve.resolve_paths(graph, t)
    return r.select("path", "id", F.array_join("candidates", ",").alias("candidates"))


@graph_query(V + """,
f AS (SELECT path FROM pg_symbols GROUP BY path ORDER BY count(*) DESC, path LIMIT 1)
SELECT id FROM pg_nodes, f WHERE starts_with(id, concat('sym:', f.path, '#s'))""")
def resolve_symbol(graph):
    most = graph.nodes.where("kind = 'symbol'").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").first()
    r = resolve.resolve(graph, f"{most.file}#s")
    return graph.spark.createDataFrame([(x,) for x in r.candidates or [r.id]], "id string")


# ---- explore


@graph_query(V + " SELECT id, name FROM pg_nodes WHERE kind = 'symbol'")
def list_nodes_by_kind(graph):
    return explore.list_nodes(graph, kind="symbol").select("id", "name")


@graph_query(V + " SELECT id, kind FROM pg_nodes WHERE language = 'rust'")
def list_nodes_by_language(graph):
    return explore.list_nodes(graph, language="rust").select("id", "kind")


@graph_query(V + " SELECT id FROM pg_nodes WHERE (kind = 'file' AND starts_with(name, 'Brand-1')) OR (kind = 'symbol' AND starts_with(file, 'Brand-1'))")
def list_nodes_by_prefix(graph):
    return explore.list_nodes(graph, prefix="Brand-1").select("id")


@graph_query(V + " SELECT id, kind, (SELECT count(*) FROM pg_nodes WHERE language = 'ts') AS total FROM pg_nodes WHERE language = 'ts' ORDER BY id COLLATE en, id LIMIT 100 OFFSET 200")
def list_nodes_page(graph):
    rows = explore.list_nodes(graph, language="ts")
    return explore.page(rows, [explore.by_locale("id"), F.col("id")], 200, 100).select("id", "kind", F.lit(rows.count()).alias("total"))


@graph_query(V + f" SELECT id, kind, language, name, (SELECT count(*) FROM pg_edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM pg_edges WHERE src = id) AS out_degree FROM pg_nodes WHERE id = {HUB_SQL}")
def get_node(graph):
    return explore.get_node(graph, hub(graph)).select("id", "kind", "language", "name", "in_degree", "out_degree")


@graph_query(V + " SELECT id, (SELECT 0) + sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM pg_edges UNION ALL SELECT src, 0, 1 FROM pg_edges) GROUP BY id")
def degrees(graph):
    return explore.degrees(graph)


@graph_query(V + " SELECT dst AS id, count(*) AS fan_in FROM pg_edges GROUP BY dst ORDER BY fan_in DESC, dst COLLATE en LIMIT 10")
def hotspots_topn(graph):
    return explore.hotspots(graph, 10)


@graph_query(V + " SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'symbol') AS symbols, count(*) FILTER (kind = 'external') AS externals, count(*) AS nodes, (SELECT count(*) FROM pg_edges) AS edges FROM pg_nodes")
def stats_counts(graph):
    return explore.kind_counts(graph)


@graph_query(V + " SELECT language, count(*) AS n FROM pg_nodes WHERE language IS NOT NULL GROUP BY language")
def stats_languages(graph):
    return explore.language_histogram(graph)


@graph_query(V + f" SELECT DISTINCT src AS id, dst AS neighbour FROM pg_edges WHERE src IN (SELECT id FROM pg_files WHERE p_size = 7)")
def one_hop_out(graph):
    return traverse.one_hop(graph, _files_of_size(graph, 7))


@graph_query(V + " SELECT DISTINCT dst AS id, src AS neighbour FROM pg_edges WHERE dst IN (SELECT id FROM pg_files WHERE p_size = 7)")
def one_hop_in(graph):
    return traverse.one_hop(graph, _files_of_size(graph, 7), reverse=True)


def _files_of_size(graph: CodeGraph, size: int) -> DataFrame:
    """Ids of the derived files whose part has this size."""
    spark = graph.spark
    part = table(spark, _sf_of(graph), "part").where(F.col("p_size") == size)
    return part.select(F.concat(F.lit("file:"), F.translate("p_brand", "#", "-"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".src")).alias("id"))


def _sf_of(graph: CodeGraph) -> str:
    """The folder that the graph was derived from."""
    return next(p for p in graph.nodes.inputFiles() if "/part.parquet" in p).split("/part.parquet")[0]


@graph_query(V + f"""
SELECT DISTINCT e.dst AS id FROM pg_edges e WHERE e.src IN (SELECT dst FROM pg_edges WHERE src IN (SELECT id FROM pg_files WHERE p_size = 7))
  AND e.dst NOT IN (SELECT dst FROM pg_edges WHERE src IN (SELECT id FROM pg_files WHERE p_size = 7)) AND e.dst NOT IN (SELECT id FROM pg_files WHERE p_size = 7)""")
def new_frontier(graph):
    """The second level of a traversal: the next nodes, without those visited before."""
    start = _files_of_size(graph, 7)
    first = traverse.one_hop(graph, start).select(F.col("neighbour").alias("id")).distinct()
    second = traverse.one_hop(graph, first).select(F.col("neighbour").alias("id")).distinct()
    return second.join(first.unionByName(start), "id", "left_anti")


@graph_query(V + " SELECT src, dst, kind FROM pg_edges WHERE src IN (SELECT id FROM pg_nodes WHERE language = 'ts') AND dst IN (SELECT id FROM pg_nodes WHERE language = 'ts')")
def visible_edges(graph):
    return overlay.between(graph.edges, graph.nodes.where("language = 'ts'")).select("src", "dst", "kind")


@graph_query(V + " SELECT id FROM pg_nodes WHERE kind = 'external' OR coalesce(file, name) NOT IN (SELECT path FROM pg_files WHERE p_size % 10 = 0)")
def base_minus_overlay(graph):
    files = _files(graph).where("p_size % 10 = 0").select(F.col("path").alias("owner_file"))
    return graph.nodes.join(files, "owner_file", "left_anti").select("id")


def _files(graph: CodeGraph) -> DataFrame:
    spark, sf = graph.spark, _sf_of(graph)
    return spark.sql(derive.VIEWS["pg_files"], part=table(spark, sf, "part"))


_NEIGHBOURS = f"""
n AS (SELECT 'in' AS side, src AS id, kind, src, dst FROM pg_edges WHERE dst = {HUB_SQL} UNION ALL SELECT 'out', dst, kind, src, dst FROM pg_edges WHERE src = {HUB_SQL}),
g AS (SELECT side, id, string_agg(concat(kind, ':', src, '>', dst), ',' ORDER BY kind) AS edges FROM n GROUP BY side, id)"""


@graph_query(V + "," + _NEIGHBOURS + " SELECT g.side, g.id, g.edges, p.kind AS node_kind, p.language, p.name FROM g JOIN pg_nodes p ON p.id = g.id")
def get_neighbors(graph):
    n = explore.neighbours(graph, hub(graph))
    return n.select("side", "id", F.array_join(F.transform("edges", lambda e: F.concat(e["kind"], F.lit(":"), e["src"], F.lit(">"), e["dst"])), ",").alias("edges"), "node_kind", "language", "name")


@graph_query(V + "," + _NEIGHBOURS + """,
c AS (SELECT count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o FROM g),
r AS (SELECT side, id, row_number() OVER (PARTITION BY side ORDER BY id COLLATE en) AS rank FROM g)
SELECT side, id, cast(rank AS int) AS rank FROM r, c WHERE rank <= CASE side WHEN 'in' THEN least(i, 3 + greatest(0, 2 - o)) ELSE least(o, 2 + greatest(0, 3 - i)) END""")
def neighbors_limit_split(graph):
    return explore.split_limit(explore.neighbours(graph, hub(graph)), 5).select("side", "id", "rank")


@graph_query(V + """
SELECT src, string_agg(dst, ',' ORDER BY dst) AS neighbours, count(*) AS n FROM (SELECT src, dst FROM pg_edges GROUP BY src, dst) GROUP BY src""")
def neighbors_grouped(graph):
    return graph.links().groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("neighbours"), F.count(F.lit(1)).alias("n"))


@graph_query(V + " SELECT id FROM pg_nodes WHERE id NOT IN (SELECT dst FROM pg_edges WHERE src <> dst)")
def safe_to_change(graph):
    return explore.safe_to_change(graph)


@graph_query(with_views("pg_nodes", recursive=True) + """,
imports AS (SELECT src, dst FROM pg_edges WHERE kind = 'import' AND src LIKE 'file:%' AND dst LIKE 'file:%' AND src <> dst),
r(a, b) AS (SELECT src, dst FROM imports UNION SELECT r.a, i.dst FROM r JOIN imports i ON i.src = r.b)
SELECT (SELECT count(DISTINCT least(a, (SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = r.a))) FROM r WHERE a = b) AS cycle_count,
       (SELECT count(*) FROM pg_nodes) AS nodes, (SELECT count(*) FROM pg_edges) AS edges,
       (SELECT string_agg(concat(dst, '=', cast(n AS varchar)), ',' ORDER BY n DESC, dst) FROM (SELECT dst, count(*) AS n FROM pg_edges GROUP BY dst ORDER BY n DESC, dst LIMIT 10)) AS hotspots""")
def get_stats(graph):
    s = tools.get_stats(graph, tools.GetStats(10))
    spots = ",".join(f"{h['id']}={h['fan_in']}" for h in s["hotspots"])
    return graph.spark.createDataFrame([(s["cycle_count"], sum(s["nodes"].values()), s["edges"], spots)], "cycle_count long, nodes long, edges long, hotspots string")


@graph_query(V + " SELECT to_json({'id': id, 'kind': kind, 'language': language, 'name': name}) AS json FROM pg_nodes WHERE kind = 'file'")
def json_envelope(graph):
    return graph.nodes.where("kind = 'file'").select(F.to_json(F.struct("id", "kind", "language", "name")).alias("json"))


# ---- traversal


def _bfs_sql(reverse: bool, depth: int | None) -> str:
    """Distances as the least number of hops of walks; without a depth, of up to 60."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    leaf = "" if reverse else " AND (w.d = 0 OR w.id NOT LIKE 'ext:%')"
    return with_views("pg_nodes", recursive=True) + f""",
links AS (SELECT DISTINCT {a} AS a, {b} AS b FROM pg_edges),
w(id, d) AS (SELECT {HUB_SQL}, 0 UNION SELECT l.b, w.d + 1 FROM w JOIN links l ON l.a = w.id WHERE w.d < {depth or 60}{leaf}),
reached AS (SELECT id, min(d) AS distance FROM w WHERE id <> {HUB_SQL} GROUP BY id)"""


@graph_query(_bfs_sql(False, 1) + " SELECT id, distance FROM reached")
def dependencies_depth1(graph):
    return traverse.reach(graph, [hub(graph)], max_depth=1).select("id", "distance")


@graph_query(_bfs_sql(False, 3) + " SELECT id, distance FROM reached")
def dependencies_depth3(graph):
    return traverse.reach(graph, [hub(graph)], max_depth=3).select("id", "distance")


@graph_query(_bfs_sql(False, 3) + f""",
origin AS (SELECT {HUB_SQL} AS id, 0 AS distance UNION ALL SELECT id, distance FROM reached),
parent AS (SELECT r.id, r.distance, min(p.id) AS parent FROM reached r JOIN links l ON l.b = r.id JOIN origin p ON p.id = l.a AND p.distance = r.distance - 1 AND (p.distance = 0 OR p.id NOT LIKE 'ext:%') GROUP BY r.id, r.distance)
SELECT x.id, x.distance, concat_ws('>', z.parent, y.parent, x.parent, x.id) AS path
FROM parent x LEFT JOIN parent y ON y.id = x.parent AND x.distance > 1 LEFT JOIN parent z ON z.id = y.parent AND x.distance > 2""")
def dependencies_paths(graph):
    return traverse.reach(graph, [hub(graph)], max_depth=3, paths=True).select("id", "distance", F.array_join("path", ">").alias("path"))


@graph_query(_bfs_sql(True, None) + " SELECT id, distance FROM reached")
def blast_radius(graph):
    return traverse.reach(graph, [hub(graph)], reverse=True).select("id", "distance")


@graph_query(_bfs_sql(True, 2) + " SELECT id, distance FROM reached")
def blast_radius_depth2(graph):
    return traverse.reach(graph, [hub(graph)], reverse=True, max_depth=2).select("id", "distance")


@graph_query(_bfs_sql(True, 4) + """,
near AS (SELECT concat('file:', substr(id, 5, strpos(id, '#') - 5)) AS id, min(distance) AS near FROM reached WHERE id LIKE 'sym:%' GROUP BY 1)
SELECT coalesce(r.id, n.id) AS id, least(r.distance, n.near) AS distance, n.near IS NOT NULL AND (r.distance IS NULL OR n.near < r.distance) AS rolled_up
FROM reached r FULL JOIN near n ON n.id = r.id""")
def blast_radius_rollup(graph):
    return traverse.roll_up(traverse.reach(graph, [hub(graph)], reverse=True, max_depth=4)).select("id", "distance", "rolled_up")


@graph_query(_bfs_sql(True, None) + " SELECT id, distance, (SELECT count(*) FROM reached) AS total, (SELECT count(*) FROM reached) >= 10 AS truncated FROM reached ORDER BY distance, id LIMIT 10")
def blast_radius_truncated(graph):
    r = traverse.reach(graph, [hub(graph)], reverse=True)
    total = r.count()
    return r.orderBy("distance", "id").limit(10).select("id", "distance", F.lit(total).alias("total"), F.lit(total >= 10).alias("truncated"))


# ---- paths

#: The hub, and the least file that is three hops ahead of it.
_GOAL_SQL = "(SELECT min(id) FROM reached WHERE distance = 3 AND id LIKE 'file:%')"


def _goal(graph: CodeGraph) -> tuple[str, str]:
    start = hub(graph)
    return start, traverse.reach(graph, [start], max_depth=3).where("distance = 3 AND id LIKE 'file:%'").agg(F.min("id")).first()[0]


def _paths_sql(direction: str, k: int, hops: int) -> str:
    swap = direction == "reverse"
    links = {"forward": "SELECT a, b FROM links", "reverse": "SELECT b AS a, a AS b FROM links", "any": "SELECT a, b FROM links UNION SELECT b, a FROM links"}[direction]
    start, goal = (_GOAL_SQL, HUB_SQL) if swap else (HUB_SQL, _GOAL_SQL)
    return _bfs_sql(False, 3) + f""",
ends AS (SELECT {start} AS s, {goal} AS g),
follow AS ({links}),
p(path, tip, n) AS (SELECT [s], s, 0 FROM ends UNION ALL SELECT list_append(p.path, f.b), f.b, p.n + 1 FROM p JOIN follow f ON f.a = p.tip, ends WHERE p.tip <> g AND NOT list_contains(p.path, f.b) AND p.n < {hops}),
found AS (SELECT row_number() OVER (ORDER BY n, path) AS rank, path FROM p, ends WHERE tip = g ORDER BY rank LIMIT {k})"""


def _traced(graph: CodeGraph, direction: str, k: int, hops: int) -> DataFrame:
    start, goal = _goal(graph)
    if direction == "reverse":
        start, goal = goal, start
    found, _ = paths.shortest(graph, start, goal, k, direction, hops)
    return found


_PATH = " SELECT cast(rank AS int) AS rank, array_to_string(path, '>') AS path FROM found"


@graph_query(_paths_sql("forward", 1, 5) + _PATH)
def trace_paths_k1(graph):
    return _traced(graph, "forward", 1, 5).select("rank", F.array_join("path", ">").alias("path"))


@graph_query(_paths_sql("forward", 3, 7) + _PATH)
def trace_paths_k3(graph):
    return _traced(graph, "forward", 3, 7).select("rank", F.array_join("path", ">").alias("path"))


@graph_query(_paths_sql("reverse", 3, 7) + _PATH)
def trace_paths_reverse(graph):
    return _traced(graph, "reverse", 3, 7).select("rank", F.array_join("path", ">").alias("path"))


@graph_query(_paths_sql("any", 5, 4) + _PATH)
def trace_paths_any(graph):
    return _traced(graph, "any", 5, 4).select("rank", F.array_join("path", ">").alias("path"))


@graph_query(_paths_sql("forward", 3, 7) + """,
steps AS (SELECT rank, i - 1 AS step, path[i] AS a, path[i + 1] AS b FROM found, generate_series(1, 8) t(i) WHERE i < len(path))
SELECT cast(s.rank AS int) AS rank, cast(s.step AS int) AS step, s.a AS src, s.b AS dst, min(e.kind) AS kind FROM steps s JOIN pg_edges e ON e.src = s.a AND e.dst = s.b GROUP BY ALL""")
def trace_path_edges(graph):
    return paths.path_edges(graph, _traced(graph, "forward", 3, 7)).select("rank", "step", "src", "dst", "kind")


# ---- cycles


def _scc_sql(where: str, kinds: str = "'file'") -> str:
    return with_views("pg_nodes", recursive=True) + f""",
own AS (SELECT id FROM pg_nodes WHERE kind IN ({kinds}) AND {where}),
l AS (SELECT DISTINCT src AS a, dst AS b FROM pg_edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT x.a AS id, min(x.b) AS root FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a),
groups AS (SELECT root, count(*) AS size, string_agg(id, '|' ORDER BY id) AS joined, array_to_string(list_slice(list_sort(list(id)), 1, 50), ',') AS nodes FROM m GROUP BY root)"""


_GROUPS = f" SELECT cast(row_number() OVER (ORDER BY size DESC, root) AS int) AS rank, {GROUP_HASH_SQL.format('joined')} AS id, cast(size AS int) AS size, nodes, size > 50 AS truncated, (SELECT count(*) FROM groups) AS total_groups FROM groups"


def _groups(rows: DataFrame) -> DataFrame:
    return rows.select("rank", "id", "size", F.array_join("nodes", ",").alias("nodes"), "truncated", "total_groups")


@graph_query(_scc_sql("true") + _GROUPS)
def detect_cycles(graph):
    return _groups(cycles.detect_cycles(graph, examples=False))


@graph_query(_scc_sql("true", "'file', 'symbol'") + _GROUPS)
def detect_cycles_symbols(graph):
    return _groups(cycles.detect_cycles(graph, "symbol", examples=False))


@graph_query(_scc_sql("starts_with(name, 'Brand-1')") + _GROUPS)
def cycles_scoped(graph):
    return _groups(cycles.detect_cycles(graph, scope="Brand-1", examples=False))


@graph_query(_scc_sql("true") + " SELECT root, count(*) AS steps_from_root, true AS closed FROM (SELECT root FROM groups) g GROUP BY root")
def cycle_examples(graph):
    """Each group's example begins and ends with its least node."""
    c = cycles.detect_cycles(graph)
    first, last = F.element_at("example", 1), F.element_at("example", -1)
    return c.select(F.element_at("nodes", 1).alias("root"), F.lit(1).cast("long").alias("steps_from_root"), ((first == last) & (first == F.element_at("nodes", 1)) & (F.size("example") > 1)).alias("closed"))


@graph_query(V + " SELECT DISTINCT src AS id FROM pg_edges WHERE src = dst")
def self_loops(graph):
    return graph.edges.where("src = dst").select(F.col("src").alias("id")).distinct()


# ---- overlays: files with p_size % 10 = 0 are replaced (by edges to the part's next two numbers), = 1 are deleted

_OVERLAY = """
ov AS (SELECT path, id, part, p_size % 10 = 1 AS deleted FROM pg_files WHERE p_size % 10 IN (0, 1)),
ov_edges AS (SELECT o.id AS src, concat('file:gone/p', cast(o.part % 50 AS varchar)) AS dst, 'import' AS kind FROM ov o WHERE NOT deleted
             UNION ALL SELECT o.id, f.id, 'import' FROM ov o JOIN pg_files f ON f.part = o.part + 1 WHERE NOT o.deleted),
kept AS (SELECT id FROM pg_nodes WHERE kind = 'external' OR coalesce(file, name) NOT IN (SELECT path FROM ov)),
ov_nodes AS (SELECT id FROM ov WHERE NOT deleted),
known AS (SELECT id FROM kept UNION SELECT id FROM ov_nodes),
stubs AS (SELECT DISTINCT dst AS id FROM ov_edges WHERE dst NOT IN (SELECT id FROM known)),
composed AS (SELECT id, 'node' AS what FROM known UNION ALL SELECT id, 'stub' FROM stubs),
owned AS (SELECT *, CASE WHEN src LIKE 'file:%' THEN substr(src, 6) ELSE substr(src, 5, strpos(src, '#') - 5) END AS owner FROM pg_edges),
composed_edges AS (SELECT src, dst, kind FROM owned WHERE owner NOT IN (SELECT path FROM ov) AND src IN (SELECT id FROM composed) AND dst IN (SELECT id FROM composed) UNION SELECT src, dst, kind FROM ov_edges)"""


def _overlay(graph: CodeGraph) -> overlay.Overlay:
    f = _files(graph).select("path", "id", "part", "p_size").where("p_size % 10 IN (0, 1)")
    # An older entry says the opposite of the one that counts.
    seq = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seq"), (F.col("p_size") % 10 == 0).alias("deleted")), F.struct(F.lit(2).cast("long").alias("seq"), (F.col("p_size") % 10 == 1).alias("deleted")))).alias("e")
    files = f.select(F.lit("wt-1").alias("worktree_id"), F.col("path").alias("owner_file"), seq).select("worktree_id", "owner_file", "e.seq", "e.deleted")
    live = f.where("p_size % 10 = 0")
    nodes = live.select("id", F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("owner_file"), F.lit("wt-1").alias("worktree_id"), F.lit(2).cast("long").alias("seq"))
    away = live.select(F.col("id").alias("src"), F.concat(F.lit("file:gone/p"), (F.col("part") % 50).cast("string")).alias("dst"), F.col("path").alias("owner_file"))
    after = _files(graph).select((F.col("part") - 1).alias("part"), F.col("id").alias("dst"))
    edges = away.unionByName(live.join(after, "part").select(F.col("id").alias("src"), "dst", F.col("path").alias("owner_file")))
    edges = edges.withColumn("kind", F.lit("import")).withColumn("worktree_id", F.lit("wt-1")).withColumn("seq", F.lit(2).cast("long"))
    full = lambda df, s: conform(df, s).withColumn("worktree_id", F.lit("wt-1")).withColumn("seq", F.lit(2).cast("long"))
    return overlay.Overlay(files, full(nodes, NODE), full(edges, EDGE))


@graph_query(V + "," + _OVERLAY + " SELECT path AS owner_file, cast(2 AS bigint) AS seq, deleted FROM ov")
def overlay_latest(graph):
    return _overlay(graph).latest().drop("worktree_id")


@graph_query(V + "," + _OVERLAY + " SELECT id, what = 'stub' AS stub FROM composed")
def composed_nodes(graph):
    n = overlay.compose(graph, _overlay(graph), "wt-1").nodes
    return n.select("id", ((F.col("kind") == "external") & ~F.col("id").startswith("ext:")).alias("stub"))


@graph_query(V + "," + _OVERLAY + " SELECT src, dst, kind FROM composed_edges")
def composed_edges(graph):
    return overlay.compose(graph, _overlay(graph), "wt-1").edges.select("src", "dst", "kind")


@graph_query(V + "," + _OVERLAY + " SELECT src, dst, kind FROM owned WHERE owner NOT IN (SELECT path FROM ov) UNION SELECT src, dst, kind FROM ov_edges")
def composed_slices(graph):
    return overlay.compose(graph, _overlay(graph), "wt-1", slices=True).edges.select("src", "dst", "kind")


@graph_query(V + "," + _OVERLAY + " SELECT id FROM stubs")
def stub_externals(graph):
    _, nodes, edges = _overlay(graph).of("wt-1")
    files = _files(graph).where("p_size % 10 IN (0, 1)").select(F.col("path").alias("owner_file"))
    known = overlay.without_files(graph.nodes, files).unionByName(nodes)
    return overlay.missing_ends(known, edges).select("id")


@graph_query(V + "," + _OVERLAY + """,
after AS (SELECT id FROM pg_nodes WHERE kind = 'external' OR coalesce(file, name) NOT IN (SELECT path FROM ov WHERE NOT deleted) UNION SELECT id FROM ov_nodes),
ends AS (SELECT id FROM after UNION SELECT dst FROM ov_edges)
SELECT src, dst, kind FROM owned WHERE owner NOT IN (SELECT path FROM ov WHERE NOT deleted) AND src IN (SELECT id FROM ends) AND dst IN (SELECT id FROM ends) UNION SELECT src, dst, kind FROM ov_edges""")
def apply_base_slice(graph):
    _, nodes, edges = _overlay(graph).of("wt-1")
    return overlay.apply_slice(graph, nodes, edges).edges.select("src", "dst", "kind")


@graph_query(V + "," + _OVERLAY + """,
left_over AS (SELECT id FROM pg_nodes WHERE kind = 'external' OR coalesce(file, name) NOT IN (SELECT path FROM ov WHERE deleted))
SELECT src, dst, kind FROM owned WHERE owner NOT IN (SELECT path FROM ov WHERE deleted) AND src IN (SELECT id FROM left_over) AND dst IN (SELECT id FROM left_over)""")
def remove_base_slice(graph):
    gone = _files(graph).where("p_size % 10 = 1").select(F.col("path").alias("owner_file"))
    return overlay.remove_slice(graph, gone).edges.select("src", "dst", "kind")


@query("SELECT src, dst, kind, max(seq) AS seq FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind, l_orderkey * 1000 + l_linenumber AS seq FROM lineitem) GROUP BY src, dst, kind")
def dedup_edges_last_wins(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"), "l_quantity")  # noqa: E741
    return overlay.last_wins(l, ["src", "dst", "kind"], "seq").select("src", "dst", "kind", "seq")


# ---- control plane, cache


@query("""
WITH r AS (SELECT concat('f', cast(o_custkey AS varchar)) AS path, CASE o_orderpriority WHEN '1-URGENT' THEN 'diff' WHEN '2-HIGH' THEN 'diff' WHEN '3-MEDIUM' THEN 'status' WHEN '4-NOT SPECIFIED' THEN 'status' ELSE 'untracked' END AS source,
             CASE o_orderkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'M' WHEN 3 THEN 'R' ELSE 'C' END AS code, o_custkey % 4 = 0 AS present, o_orderkey AS line FROM orders),
w AS (SELECT *, CASE WHEN source = 'status' AND code = 'D' THEN 4 WHEN source = 'status' AND code = 'A' THEN 3 WHEN source = 'diff' THEN 2 WHEN source = 'status' THEN 1 ELSE 0 END AS p,
             CASE WHEN source = 'untracked' THEN 'added' WHEN code = 'D' THEN 'deleted' WHEN code = 'A' OR (source = 'diff' AND code = 'C') THEN 'added' ELSE 'changed' END AS s FROM r)
SELECT path, CASE WHEN s = 'deleted' AND present THEN 'changed' ELSE s END AS status FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p DESC, line DESC) AS n FROM w) WHERE n = 1""")
def changed_files_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    source = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'diff' WHEN '2-HIGH' THEN 'diff' WHEN '3-MEDIUM' THEN 'status' WHEN '4-NOT SPECIFIED' THEN 'status' ELSE 'untracked' END")
    code = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'M' WHEN 3 THEN 'R' ELSE 'C' END")
    reports = o.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path"), source.alias("source"), code.alias("code"), (F.col("o_custkey") % 4 == 0).alias("present"), F.col("o_orderkey").alias("line"))
    return control.merge_changes(reports)


_CACHED = "SELECT concat('d', cast(d.doc_id AS varchar)) AS path, sha256(d.text) AS hash FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id"


@query(f"WITH f AS (SELECT concat('d', cast(doc_id AS varchar)) AS path, sha256(text) AS hash FROM documents), c AS ({_CACHED}) SELECT path, hash, EXISTS (SELECT 1 FROM c WHERE c.path = f.path AND c.hash = f.hash) AS hit FROM f")
def parse_cache_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = ingest.with_key(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text"))
    known = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")).distinct()
    hits, misses = ingest.lookup(files, files.join(known, "path", "left_semi"))
    return hits.select("path", "hash", F.lit(True).alias("hit")).unionByName(misses.select("path", "hash", F.lit(False).alias("hit")))


@query("SELECT cast(user_id AS varchar) AS path, cast(event_id AS varchar) AS hash FROM events ORDER BY ts DESC, cast(user_id AS varchar), cast(event_id AS varchar) LIMIT 500")
def lru_eviction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("string").alias("hash"), F.col("ts").alias("accessed_at"))
    return ingest.evict(rows, 500).select("path", "hash")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-05 00:00:00'")
def idle_sessions(spark, sf_dir):
    return control.idle(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-05 00:00:00")


# ---- change feed: events of seven roots; a session ends after ten minutes

_FEED = """
feed AS (SELECT concat('r', cast(user_id % 7 AS varchar)) AS root, ts, event_id AS seq, concat('dir', cast(user_id % 3 AS varchar), '/u', cast(user_id % 40 AS varchar), CASE WHEN user_id % 2 = 0 THEN '.ts' ELSE '.py' END) AS path,
                CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'unlink' ELSE 'change' END AS type FROM events),
marked AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY root ORDER BY ts, seq) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM feed),
sess AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY root ORDER BY ts, seq) AS session FROM marked)"""

#: Folding a path's events in SQL: state letters by position, one row at a time.
_COALESCED = _FEED + """,
n AS (SELECT root, session, path, ts, seq, type, row_number() OVER (PARTITION BY root, session, path ORDER BY ts, seq) AS i FROM sess),
fold(root, session, path, i, type, ts, seq) AS (
  SELECT root, session, path, i, type, ts, seq FROM n WHERE i = 1
  UNION ALL
  SELECT n.root, n.session, n.path, n.i,
         CASE WHEN f.type = 'add' AND n.type = 'unlink' THEN NULL WHEN f.type = 'add' AND n.type = 'change' THEN 'add' ELSE n.type END,
         CASE WHEN f.type IS NULL THEN n.ts ELSE f.ts END, CASE WHEN f.type IS NULL THEN n.seq ELSE f.seq END
  FROM fold f JOIN n ON n.root = f.root AND n.session = f.session AND n.path = f.path AND n.i = f.i + 1),
changed AS (SELECT root, session, path, type, ts, seq FROM fold f WHERE type IS NOT NULL AND i = (SELECT max(i) FROM n WHERE n.root = f.root AND n.session = f.session AND n.path = f.path))"""

_MOVES = _COALESCED + """,
d AS (SELECT *, regexp_extract(path, '^(.*)/', 1) AS dir, regexp_extract(path, '\\.[^.]*$') AS ext FROM changed),
k AS (SELECT *, row_number() OVER (PARTITION BY root, session, dir, ext, type ORDER BY ts, seq, path) AS nth FROM d),
paired AS (SELECT coalesce(u.root, a.root) AS root, coalesce(u.session, a.session) AS session, CASE WHEN a.path IS NULL THEN 'unlink' WHEN u.path IS NULL THEN 'add' ELSE 'move' END AS type,
                  coalesce(a.path, u.path) AS path, CASE WHEN a.path IS NOT NULL THEN u.path END AS old_path, coalesce(u.ts, a.ts) AS ts, coalesce(u.seq, a.seq) AS seq
           FROM (SELECT * FROM k WHERE type = 'unlink') u FULL JOIN (SELECT * FROM k WHERE type = 'add') a USING (root, session, dir, ext, nth)
           UNION ALL SELECT root, session, type, path, NULL, ts, seq FROM k WHERE type = 'change'),
moved AS (SELECT root, session, type, path, old_path, cast(row_number() OVER (PARTITION BY root, session ORDER BY list_position(['move', 'unlink', 'add', 'change'], type), ts, seq, path) AS int) AS place FROM paired)"""

_GAP_MS = 600_000


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    path = F.concat(F.lit("dir"), (u % 3).cast("string"), F.lit("/u"), (u % 40).cast("string"), F.when(u % 2 == 0, ".ts").otherwise(".py"))
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return e.select(F.concat(F.lit("r"), (u % 7).cast("string")).alias("root"), "ts", F.col("event_id").alias("seq"), path.alias("path"), kind.alias("type"))


@query("WITH " + _FEED + " SELECT root, cast(session AS bigint) AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM sess GROUP BY root, session")
def debounce_sessions(spark, sf_dir):
    s = changes.sessions(_feed(spark, sf_dir), _GAP_MS)
    return s.groupBy("root", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE " + _COALESCED + " SELECT root, cast(session AS bigint) AS session, path, type, ts, seq FROM changed")
def coalesce_events(spark, sf_dir):
    return changes.coalesce(changes.sessions(_feed(spark, sf_dir), _GAP_MS))


@query("WITH RECURSIVE " + _MOVES + " SELECT root, cast(session AS bigint) AS session, type, path, old_path, place FROM moved")
def coalesce_moves(spark, sf_dir):
    return changes.moves(changes.coalesce(changes.sessions(_feed(spark, sf_dir), _GAP_MS)))


@query("WITH RECURSIVE " + _MOVES + " SELECT root, cast(session AS bigint) AS session, count(*) AS n, count(*) >= 10 AS bulk FROM moved GROUP BY root, session")
def bulk_batches(spark, sf_dir):
    b = changes.batches(_feed(spark, sf_dir), _GAP_MS, 10)
    return b.groupBy("root", "session", "bulk").agg(F.count(F.lit(1)).alias("n")).select("root", "session", "n", "bulk")


@query("WITH RECURSIVE " + _MOVES + """
SELECT DISTINCT concat('file:', path) AS id, action FROM (
  SELECT path, CASE type WHEN 'unlink' THEN 'remove' ELSE 'analyze' END AS action FROM moved UNION ALL SELECT old_path, 'remove' FROM moved WHERE type = 'move')""")
def incremental_changed_ids(spark, sf_dir):
    e = changes.effects(changes.batches(_feed(spark, sf_dir), _GAP_MS))
    return e.select(ids.file_id(F.col("path")).alias("id"), "action").distinct()


@graph_query(V + " SELECT DISTINCT src AS id FROM pg_edges WHERE src LIKE 'file:%' AND dst IN (SELECT id FROM pg_files WHERE p_size = 7)")
def reresolve_dependents(graph):
    return changes.dependents(graph.edges, graph.nodes, _files_of_size(graph, 7))


# ---- ingest: generated sources of the derived files, one language at a time

_LINES = "SELECT DISTINCT a.part, a.path, b.part AS to_part, b.path AS to_path FROM pg_steps t JOIN pg_files a ON t.p = a.part JOIN pg_files b ON t.n = b.part"


def _generated(spark: SparkSession, sf_dir: str, line: str, declare: str, ext: str, first: str = "") -> DataFrame:
    """(path, text): a file per part; `line` per next part {n} and `declare` per supplier {s}, in braces as SQL."""
    v = derive.views(spark, sf_dir)
    f = v["pg_files"].select("part")
    steps = v["pg_steps"].select("p", "n", "s")
    imports = steps.groupBy(F.col("p").alias("part")).agg(F.array_join(F.sort_array(F.collect_set(F.expr(line))), "\n").alias("imports"))
    symbols = steps.groupBy(F.col("p").alias("part")).agg(F.array_join(F.sort_array(F.collect_set(F.expr(declare))), "\n").alias("symbols"))
    t = f.join(imports, "part", "left").join(symbols, "part", "left")
    folder = F.concat(F.lit("d"), (F.col("part") % 5).cast("string"))
    return t.select(F.concat(folder, F.lit("/p"), F.col("part").cast("string"), F.lit(ext)).alias("path"), F.concat_ws("\n", F.lit(first), "imports", "symbols").alias("text"))


def _ingested(files: DataFrame, config: dict) -> DataFrame:
    g = ingest.build(files, config)
    nodes = g.nodes.where("kind = 'symbol'").select(F.lit("symbol").alias("what"), F.col("id").alias("a"), F.col("symbol_kind").alias("b"))
    edges = g.edges.where("kind = 'import'").select(F.lit("import").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return nodes.unionByName(edges)


def _ingest_sql(ext: str, kind: str, outside: str, offset: int = 3) -> str:
    """Every third target is a package that the project doesn't have."""
    at = "concat('d', cast({0} % 5 AS varchar), '/p', cast({0} AS varchar), '" + ext + "')"
    return with_views("pg_steps") + f"""
SELECT DISTINCT 'symbol' AS what, concat('sym:', {at.format('p')}, '#s', cast(s AS varchar)) AS a, '{kind}' AS b FROM pg_steps
UNION ALL SELECT DISTINCT 'import', concat('file:', {at.format('p')}), CASE WHEN n % 3 = 0 THEN {outside} ELSE concat('file:', {at.format('n')}) END FROM pg_steps"""


@query(_ingest_sql(".py", "function", "concat('ext:lib', cast(n AS varchar))"))
def analyze_python(spark, sf_dir):
    line = "CASE WHEN n % 3 = 0 THEN concat('import lib', cast(n AS string), '.sub as x') WHEN n % 3 = 1 THEN concat('from d', cast(n % 5 AS string), '.p', cast(n AS string), ' import y') ELSE concat('from ..d', cast(n % 5 AS string), '.p', cast(n AS string), ' import (a, b)') END"
    return _ingested(_generated(spark, sf_dir, line, "concat('def s', cast(s AS string), '(): pass  # import no')", ".py", '"""import nothing"""'), {})


@query(_ingest_sql(".ts", "class", "concat('ext:@lib/p', cast(n AS varchar))"))
def analyze_typescript(spark, sf_dir):
    line = "CASE WHEN n % 3 = 0 THEN concat('import x', cast(n AS string), ' from \\'@lib/p', cast(n AS string), '/sub\\';') WHEN n % 3 = 1 THEN concat('import { a as b', cast(n AS string), ' } from \"../d', cast(n % 5 AS string), '/p', cast(n AS string), '.js\";') ELSE concat('export * from \\'../d', cast(n % 5 AS string), '/p', cast(n AS string), '\\'') END"
    files = _generated(spark, sf_dir, line, "concat('export class s', cast(s AS string), ' { f() { const no = 1; } }')", ".ts", "// import z from 'zz'")
    packages = [f"@lib/p{r.n}" for r in derive.views(spark, sf_dir)["pg_steps"].select("n").where("n % 3 = 0").distinct().collect()]
    return _ingested(files, {"script": {"packages": packages}})


@query(_ingest_sql(".rs", "struct", "concat('ext:rust:lib::p', cast(n AS varchar))"))
def analyze_rust(spark, sf_dir):
    line = "CASE WHEN n % 3 = 0 THEN concat('use lib::p', cast(n AS string), ';') WHEN n % 3 = 1 THEN concat('pub use crate::d', cast(n % 5 AS string), '::{p', cast(n AS string), '::Thing as T};') ELSE concat('use super::d', cast(n % 5 AS string), '::p', cast(n AS string), '::*;') END"
    files = _generated(spark, sf_dir, line, "concat('pub struct s', cast(s AS string), ' { x: u8 }')", ".rs", "/* use no::thing; */")
    return _ingested(files, {"rust": {"crate_root": "lib.rs", "crate_name": "own", "crates": ["lib"]}})


@query(_ingest_sql(".c", "struct", "concat('ext:p', cast(n AS varchar), '.h')"))
def analyze_c(spark, sf_dir):
    line = "CASE WHEN n % 3 = 0 THEN concat('#include <p', cast(n AS string), '.h>') WHEN n % 3 = 1 THEN concat('#include \"../d', cast(n % 5 AS string), '/p', cast(n AS string), '.c\"') ELSE concat('#  include <d', cast(n % 5 AS string), '/p', cast(n AS string), '.c> // yes') END"
    files = _generated(spark, sf_dir, line, "concat('struct s', cast(s AS string), ' { int no; };')", ".c", '// #include "no.h"')
    return _ingested(files, {"cpp": {"include_dirs": [""]}})


@query(_ingest_sql(".m", "class", "concat('ext:objc:Kit', cast(n AS varchar))"))
def analyze_objc(spark, sf_dir):
    line = "CASE WHEN n % 3 = 0 THEN concat('@import Kit', cast(n AS string), ';') WHEN n % 3 = 1 THEN concat('#import \"../d', cast(n % 5 AS string), '/p', cast(n AS string), '.m\"') ELSE concat('#import <d', cast(n % 5 AS string), '/p', cast(n AS string), '.m>') END"
    files = _generated(spark, sf_dir, line, "concat('@interface s', cast(s AS string), ' : NSObject\\n@end')", ".m")
    return _ingested(files, {"objc": {"include_dirs": [""]}})


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS spec FROM pages),
listing AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/$', '') AS path FROM pages),
c AS (SELECT DISTINCT l.page_id, l.spec, CASE WHEN EXISTS (SELECT 1 FROM listing WHERE path = regexp_replace(l.spec, '/$', '')) THEN regexp_replace(l.spec, '/$', '') WHEN EXISTS (SELECT 1 FROM listing WHERE path = concat(regexp_replace(l.spec, '/$', ''), '/index.html')) THEN concat(regexp_replace(l.spec, '/$', ''), '/index.html') END AS found FROM l)
SELECT page_id, spec, found FROM c""")
def resolve_imports(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listing = pages.select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/$", "").alias("path"))
    links = pages.select("page_id", F.explode(F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")).alias("spec")).distinct()
    base = F.regexp_replace("spec", "/$", "")
    rows = links.select(F.col("page_id").cast("string").alias("path"), F.lit("import").alias("record"), F.xxhash64("spec").alias("seq"), "page_id", "spec", F.array(base, F.concat(base, F.lit("/index.html"))).alias("candidates"))
    return ingest._resolved(rows, listing).select("page_id", "spec", "found")


# ---- loops in the cluster, whatever the size


def _in_cluster(run):
    def forced(spark: SparkSession, sf_dir: str) -> DataFrame:
        with storage.driver_edges(0):
            return run(spark, sf_dir)

    return forced


for _name in ("dependencies_depth3", "dependencies_paths", "blast_radius", "blast_radius_rollup", "trace_paths_k3", "trace_paths_any", "detect_cycles"):
    QUERIES[f"{_name}_distributed"] = _in_cluster(QUERIES[_name])
    ORACLES[f"{_name}_distributed"] = ORACLES[_name]
