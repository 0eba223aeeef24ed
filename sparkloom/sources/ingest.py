"""From a source tree to a graph: scan, cached analysis in parallel, resolution by joins with the list of files."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import storage
from ..plans.graph import EDGE, NODE, CodeGraph, conform
from .analyzers import Fragment, cpp, objc, python, rust, script

VERSION = "1"
CACHE_ROWS = 50_000

RECORD = (
    "path string, record string, seq int, language string, name string, kind string, line int, col int, exported boolean, suffix string, numbered boolean, "
    "specifier string, candidates array<string>, otherwise string, resolution string, wildcard boolean, type_only boolean, target string, source string"
)
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


#: Analyzers that were registered: extension to (group, function), group to function.
_BY_EXTENSION: dict[str, tuple[str, Callable[[str, str, dict], Fragment]]] = {}
_BY_GROUP: dict[str, Callable[[str, str, dict], Fragment]] = {}


def register(group: str, extensions: tuple[str, ...], function: Callable[[str, str, dict], Fragment]) -> None:
    """Adds an analyzer for files of these extensions (in any case, with their dot). The last one registered for an
    extension or a group wins, also over those that are built in. Its configuration is config[group]; it goes to the
    executors with the job, so it may come from any module that they can import, or from a notebook."""
    _BY_GROUP[group] = function
    for e in extensions:
        _BY_EXTENSION[e.lower()] = (group, function)


def registered(group: str) -> Callable[[str, str, dict], Fragment] | None:
    """The analyzer of a group, built in or registered."""
    built_in = {"python": python.analyze, "script": script.analyze, "rust": rust.analyze, "objc": objc.analyze, "cpp": cpp.analyze}
    return _BY_GROUP.get(group) or built_in.get(group)


def analyzer_of(path: str, text: str, own: dict | None = None):
    """(group, analyze) for a file, by its extension; a header is Objective-C if its text says so. own: registered ones."""
    ext = posixpath.splitext(path)[1].lower()
    if ext in (_BY_EXTENSION if own is None else own):
        return (_BY_EXTENSION if own is None else own)[ext]
    if ext in python.EXTENSIONS:
        return "python", python.analyze
    if ext in script.EXTENSIONS:
        return "script", script.analyze
    if ext in rust.EXTENSIONS:
        return "rust", rust.analyze
    if ext in objc.EXTENSIONS or (ext in cpp.HEADERS and objc.MARKS.search(text)):
        return "objc", objc.analyze
    if ext in cpp.EXTENSIONS:
        return "cpp", cpp.analyze
    return None


def records(path: str, f: Fragment) -> list[dict]:
    """A fragment as flat rows."""
    out = [{"record": "file", "seq": 0}]
    for i, s in enumerate(f.symbols):
        out.append({"record": "symbol", "seq": i, "name": s.name, "kind": s.kind, "line": s.line, "col": s.col, "exported": s.exported, "suffix": s.suffix, "numbered": s.numbered})
    for i, m in enumerate(f.imports):
        out.append({"record": "import", "seq": i, "specifier": m.specifier, "line": m.line, "col": m.col, "candidates": m.candidates, "otherwise": m.otherwise, "resolution": m.resolution, "wildcard": m.wildcard, "type_only": m.type_only})
    for i, r in enumerate(f.references):
        out.append({"record": "reference", "seq": i, "name": r.name, "line": r.line, "col": r.col, "candidates": r.candidates, "target": r.target, "source": r.source, "type_only": r.type_only})
    for i, e in enumerate(f.exports):
        out.append({"record": "export", "seq": i, "name": e.name, "specifier": e.of, "candidates": e.candidates})
    return [{"path": path, "language": f.language, **r} for r in out]


#: Folders that a scan leaves out, wherever they are.
LEFT_OUT = ("node_modules", ".git", "dist", "build", ".next", "__pycache__", "target")


def listing(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path relative to root, bytes) of the tree's files in order: no links, no dot files, nothing in a folder of
    LEFT_OUT or that an ignored glob matches. Lists names only, as any reader of a folder does."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    prefix = len(fs.makeQualified(base).toString().rstrip("/")) + 1
    patterns = [re.compile(ids.glob_regex(g)) for g in ignore]
    out, todo = [], [base]
    while todo:
        for status in fs.listStatus(todo.pop()):
            path, name = status.getPath().toString()[prefix:], status.getPath().getName()
            if name.startswith(".") or name in LEFT_OUT and status.isDirectory() or any(p.search(f"/{path}") for p in patterns):
                continue
            if status.isDirectory():
                if not _is_link(status.getPath()):
                    todo.append(status.getPath())
            elif not status.isSymlink():
                out.append((path, status.getLen()))
    return sorted(out)


def _is_link(path) -> bool:
    uri = path.toUri()
    return uri.getScheme() == "file" and os.path.islink(uri.getPath())


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the tree's files. Bytes that are no UTF-8 become replacement characters.

    Spark's reader skips names that begin with an underscore, and empty files; the first are read by the executors
    through Arrow's file systems, the others need no reading.
    """
    files = listing(spark, root, ignore)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(base).toString().rstrip("/")
    own = spark.createDataFrame([(p,) for p, n in files if n and not _hidden(p)], "path string")
    seen = raw.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), "content").join(own, "path", "left_semi")
    hidden = [(p,) for p, n in files if n and _hidden(p)]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(f"{base}/{path}".replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file:///") else f"{base}/{path}")
                with store.open_input_stream(at) as f:
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [f.read()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    under = spark.createDataFrame(hidden, "path string").mapInArrow(fetch, "path string, content binary")
    empty = spark.createDataFrame([(p, b"") for p, n in files if not n], "path string, content binary")
    every = seen.unionByName(under).unionByName(empty)
    return every.select("path", F.expr("make_valid_utf8(content)").alias("text"))


def _hidden(path: str) -> bool:
    return any(part.startswith("_") for part in path.split("/"))


def analyze(files: DataFrame, config: dict[str, dict]) -> DataFrame:
    """Records of files (path, text); a file without analyzer has none."""

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
    own = dict(_BY_EXTENSION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = None
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = analyzer_of(path, text or "", own) if path else None
                if found:
                    given = config.get(found[0], {})
                    if found == ("script", script.analyze):
                        given = scripts = scripts or script.prepared(given)
                    rows += records(path, found[1](path, text or "", given))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "text").mapInArrow(run, RECORD)


def _resolved(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """rows (path, record, seq, candidates, ...) with `file`: the first candidate that is in the listing (path).

    Candidates meet the list of files in a join; nothing looks at a disk."""
    key = ["path", "record", "seq"]
    each = rows.select(*key, F.posexplode("candidates").alias("nth", "candidate"))
    hit = each.join(listing.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    first = hit.groupBy(*key).agg(F.min_by("candidate", "nth").alias("found"))
    return rows.join(first, key, "left")


def _location() -> F.Column:
    return F.struct(F.col("line"), F.col("col")).alias("loc")


def nodes_of(raw: DataFrame) -> DataFrame:
    """File and symbol nodes of records; repeated names are numbered in order, where the language does so."""
    file = raw.where("record = 'file'").select(ids.file_id(F.col("path")).alias("id"), F.lit("file").alias("kind"), "language", F.col("path").alias("name"), F.col("path").alias("owner_file"))
    nth = ids.collision_number("path", "name", order=["seq"])
    s = raw.where("record = 'symbol'").withColumn("nth", F.when(F.col("numbered"), nth).otherwise(0))
    own = F.concat("name", F.when(F.col("nth") > 0, F.concat("suffix", F.col("nth").cast("string"))).otherwise(F.lit("")))
    symbol = s.select(
        ids.symbol_id(F.col("path"), own).alias("id"), F.lit("symbol").alias("kind"), "language", "name", F.col("kind").alias("symbol_kind"), F.col("path").alias("file"), "exported", _location(), F.col("path").alias("owner_file"), "seq"
    )
    first = symbol.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("n = 1")
    return conform(file, NODE).unionByName(conform(first, NODE))


def import_edges(raw: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges of imports, one per (file, target) with the place of the first; with `specifier` and `found`."""
    r = _resolved(raw.where("record = 'import'"), listing)
    dst = F.when(F.col("found").isNotNull(), ids.file_id(F.col("found"))).otherwise(F.col("otherwise"))
    return r.select(
        ids.file_id(F.col("path")).alias("src"), dst.alias("dst"), F.lit("import").alias("kind"), F.when(dst.startswith("ext:"), "external").otherwise("file").alias("target_type"),
        "type_only", "wildcard", F.when(F.col("found").isNotNull(), "resolved").otherwise(F.col("resolution")).alias("resolution"), _location(), F.col("path").alias("owner_file"), "specifier", "found", "language", "seq",
    )


def follow_exports(wanted: DataFrame, raw: DataFrame, listing: DataFrame) -> DataFrame:
    """wanted (path, seq, file, name) with `dst`: the symbol that file's name stands for, through re-exports.

    Each round is one join with the re-exports for the names that are left; a barrel takes one round, however many
    names pass it. Rounds end when no name is left that hasn't been looked for in its file, so chains may be of any
    length, and circles end."""
    symbols = raw.where("record = 'symbol'").select(F.col("path").alias("file"), F.col("name").alias("of"), "language").distinct()
    e = _resolved(raw.where("record = 'export'"), listing).select(F.col("path").alias("file"), "name", F.col("specifier").alias("of"), "found", F.size("candidates").alias("n"))
    own = e.where("n = 0").join(symbols.select("file", "of"), ["file", "of"], "left_semi").select("file", "name", "of")
    # Every top-level name of a Python module can be imported.
    own = own.unionByName(symbols.where("language = 'python'").select("file", F.col("of").alias("name"), "of")).distinct()
    own = storage.written(own, "exports")
    on = storage.written(e.where("found IS NOT NULL").select("file", "name", "of", "found"), "reexports")
    left, done = storage.written(wanted.select("path", "seq", "file", "name"), "wanted"), None
    seen = left
    while not left.isEmpty():
        hit = left.join(own, ["file", "name"]).groupBy("path", "seq").agg(F.min(ids.symbol_id(F.col("file"), F.col("of"))).alias("dst"))
        hit = storage.written(hit, "names")
        done = hit if done is None else done.unionByName(hit)
        left = left.join(hit, ["path", "seq"], "left_anti")
        named = left.join(on, ["file", "name"]).select("path", "seq", F.col("found").alias("to"), F.col("of").alias("name"))
        star = left.where("name <> 'default'").join(on.where("name = '*'").select("file", "found"), "file").select("path", "seq", F.col("found").alias("to"), "name")
        new = named.unionByName(star).select("path", "seq", F.col("to").alias("file"), "name").distinct()
        left = storage.written(new.join(seen, ["path", "seq", "file", "name"], "left_anti"), "wanted")
        seen = seen.unionByName(left)
    none = wanted.select("path", "seq", F.lit(None).cast("string").alias("dst")).limit(0)
    return wanted.join(none if done is None else done, ["path", "seq"])


def reference_edges(raw: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges of references to other files' symbols, to external packages, and to Objective-C classes by name."""
    r = _resolved(raw.where("record = 'reference'"), listing)
    through = follow_exports(r.where("target IS NULL AND found IS NOT NULL AND found <> path AND name <> '*'").withColumn("file", F.col("found")), raw, listing)
    whole = r.where("target IS NULL AND found IS NOT NULL AND found <> path AND name = '*'").withColumn("dst", ids.file_id(F.col("found")))
    classes = raw.where("record = 'symbol' AND language = 'objc' AND kind = 'class'").select("name", F.col("path").alias("in_file")).groupBy("name").agg(F.min("in_file").alias("in_file"))
    by_name = r.where("target LIKE 'sym:?#%'").join(classes, "name", "left").withColumn("dst", F.when(F.col("in_file").isNotNull(), ids.symbol_id(F.col("in_file"), F.col("name"))).otherwise(F.col("target")))
    outside = r.where("target LIKE 'ext:%'").withColumn("dst", F.col("target"))
    src = F.when(F.col("source").isNotNull(), ids.symbol_id(F.col("path"), F.col("source"))).otherwise(ids.file_id(F.col("path")))
    kind = F.when(F.col("dst").startswith("ext:"), "external").when(F.col("dst").startswith("file:"), "file").otherwise("symbol")

    def edges(df: DataFrame) -> DataFrame:
        state = F.when(F.col("dst").startswith("sym:?#"), "unresolved").otherwise("resolved")
        return df.select(src.alias("src"), "dst", F.lit("reference").alias("kind"), kind.alias("target_type"), "type_only", F.lit(None).cast("boolean").alias("wildcard"), state.alias("resolution"), _location(), F.col("path").alias("owner_file"), "language", "seq")

    rows = through.drop("file")
    out = edges(rows)
    for more in (whole, by_name, outside):
        out = out.unionByName(edges(more))
    return out


def build(files: DataFrame, config: dict[str, dict], listing: DataFrame | None = None, python_references: bool = False) -> CodeGraph:
    """The graph of files (path, text). listing: all files of the project, where files are only some of them.

    Python's references are found but, as by default nothing uses them, only kept if asked for."""
    raw = storage.written(analyze(files, config), "records")
    return resolve(raw, files if listing is None else listing, python_references)


def resolve(raw: DataFrame, listing: DataFrame, python_references: bool = False) -> CodeGraph:
    """The graph of analyzed records."""
    nodes = nodes_of(raw)
    kept = raw if python_references else raw.where("NOT (record = 'reference' AND language = 'python')")
    both = import_edges(raw, listing).drop("specifier", "found").unionByName(reference_edges(kept, listing))
    rank = F.row_number().over(Window.partitionBy("src", "kind", "dst").orderBy("seq"))
    both = storage.written(both.withColumn("n", rank).where("n = 1").drop("n"), "edges")
    # An id that ends in a second colon's part names its language.
    spec = F.regexp_replace("dst", r"^ext:(?:(?:rust|objc):)?", "")
    outside = both.where("dst LIKE 'ext:%'").groupBy(F.col("dst").alias("id")).agg(F.min("language").alias("language"), F.min(spec).alias("name")).withColumn("kind", F.lit("external"))
    return CodeGraph(nodes.unionByName(conform(outside, NODE)), conform(both, EDGE))


# ---- parse cache: fragments by analyzer version, text and path


def with_key(files: DataFrame) -> DataFrame:
    """files (path, text) with the cache key (version, hash); the path is part of the key, as ids hold it."""
    return files.withColumn("version", F.lit(VERSION)).withColumn("hash", ids.content_hash(F.col("text")))


def lookup(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files with a key, against cache (path, version, hash, ...)."""
    key = ["path", "version", "hash"]
    return files.join(cache.select(*key).distinct(), key, "left_semi"), files.join(cache.select(*key).distinct(), key, "left_anti")


def evict(cache: DataFrame, rows: int = CACHE_ROWS) -> DataFrame:
    """The `rows` keys that were used last."""
    return cache.orderBy(F.desc("accessed_at"), "path", "hash").limit(rows)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table that may not be there yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def used_last(spark: SparkSession, folder: str) -> DataFrame:
    """(path, version, hash, accessed_at) of the cache under folder: when each key was last put or found."""
    uses = _table(spark, f"{folder}/_uses")
    none = spark.createDataFrame([], "path string, version string, hash string, accessed_at timestamp")
    return (none if uses is None else uses).groupBy(*KEY).agg(F.max("accessed_at").alias("accessed_at"))


def trim(spark: SparkSession, folder: str, rows: int = CACHE_ROWS) -> None:
    """Leaves the `rows` keys that were used last in the cache under folder. Nobody else may use it meanwhile."""
    keys = storage.written(evict(used_last(spark, folder), rows), "cache-keys")
    cached = _table(spark, folder)
    if cached is not None:
        storage.written(cached.join(keys.select(*KEY), KEY, "left_semi"), "cache-kept").write.mode("overwrite").parquet(folder)
    # Within the folder, under a name that Spark's readers skip.
    keys.write.mode("overwrite").parquet(f"{folder}/_uses")


KEY = ["path", "version", "hash"]


def analyze_cached(files: DataFrame, config: dict[str, dict], folder: str, rows: int = CACHE_ROWS) -> DataFrame:
    """Records of files, taken from the cache under folder where their text is known there; new ones are put into it.

    Keys that were found or put are the last used ones; when a put leaves more than `rows` keys, those that weren't used
    for longest go. A key that is put twice is there once."""
    spark = files.sparkSession
    keyed = storage.written(with_key(files), "cache-files")
    cache = _table(spark, folder)
    misses, known = keyed, None
    if cache is not None:
        hits, misses = lookup(keyed, cache)
        known = storage.written(cache.join(hits.select(*KEY).distinct(), KEY, "left_semi").distinct(), "cache-hits")
    fresh = analyze(misses, config).join(misses.select(*KEY).distinct(), "path")
    fresh = storage.written(fresh.distinct(), "cache-new")
    put = not fresh.isEmpty()
    if put:
        fresh.write.mode("append").parquet(folder)
    found = fresh if known is None else known.unionByName(fresh)
    found.select(*KEY).distinct().withColumn("accessed_at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/_uses")
    if put and used_last(spark, folder).limit(rows + 1).count() > rows:
        trim(spark, folder, rows)
    return found.select(*_COLUMNS)
