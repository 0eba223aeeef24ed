"""Node identifiers, paths and hashes as column expressions; all stay in whole-stage code or plain Catalyst functions.

A file is ``file:<path>``, a symbol ``sym:<path>#<name>`` (with ``~N`` from the second of a name on), an external
package ``ext:<spec>`` or ``ext:<language>:<spec>``. Whatever begins with neither file: nor sym: counts as external.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FILE, SYMBOL, EXTERNAL = "file:", "sym:", "ext:"

#: What the change feed and the scanner always leave out.
IGNORED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/__pycache__/**", "**/*.pyc", "**/*.pyo")

#: Any of these in a header's text makes it C++.
CPP_SIGNS = (
    r"\bclass\s+\w", r"\bnamespace\s+(?:\w|\{)", r"\btemplate\s*<", r"\boperator\s*[^a-zA-Z_\s]", r"\bconstexpr\b",
    r"\bnullptr\b", r"\boverride\b", r"\bstatic_assert\s*\(", r"#include\s*<[a-z_]+>(?!\s*//)", r"\bstd\s*::",
)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_id(path: Column) -> Column:
    return F.concat(F.lit(FILE), slashes(path))


def symbol_id(path: Column, name: Column, number: Column | int = 0) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    suffix = F.when(number > 0, F.concat(F.lit("~"), number.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit(SYMBOL), path, F.lit("#"), name, suffix)


def external_id(spec: Column, language: Column | None = None) -> Column:
    return F.concat(F.lit(EXTERNAL), spec) if language is None else F.concat(F.lit(EXTERNAL), language, F.lit(":"), spec)


def collision_number(*name: Column | str, order: list) -> Column:
    """0 for the first of a name in the given order, then 1, 2, ..."""
    return F.row_number().over(Window.partitionBy(*name).orderBy(*order)) - 1


def node_kind(node: Column) -> Column:
    return F.when(node.startswith(FILE), "file").when(node.startswith(SYMBOL), "symbol").otherwise("external")


def file_path(node: Column) -> Column:
    """The path in a file's or symbol's id; null for any other. A symbol's path ends at the first #."""
    rest = F.substring(node, 5, 1 << 30)
    return F.when(node.startswith(FILE), F.substring(node, 6, 1 << 30)).when(node.startswith(SYMBOL), F.substring_index(rest, "#", 1))


def symbol_name(node: Column) -> Column:
    """What follows the first # of a symbol's id."""
    return F.when(node.startswith(SYMBOL) & node.contains("#"), _after(node, "#"))


def _after(text: Column, mark: str) -> Column:
    return text.substr(F.instr(text, mark) + F.lit(1), F.lit(1 << 30))


def containing_file(node: Column) -> Column:
    """Id of the file that a symbol stands in; null for files and externals."""
    return F.when(node.startswith(SYMBOL) & (F.length(file_path(node)) > 0), F.concat(F.lit(FILE), file_path(node)))


def display_name(node: Column) -> Column:
    path = F.element_at(F.split(F.substring(node, 6, 1 << 30), "/"), -1)
    return F.when(node.startswith(FILE), path).when(node.startswith(SYMBOL), F.coalesce(symbol_name(node), node)).otherwise(F.substring(node, 5, 1 << 30))


def parse_node_id(node: Column) -> Column:
    """struct<kind, path, name, language, specifier>, null for what is no id: a symbol without #, an external without
    a second colon, any other prefix."""
    rest = F.substring(node, 5, 1 << 30)
    none = F.lit(None).cast("string")

    def parsed(kind, path=none, name=none, language=none, specifier=none):
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"), language.alias("language"), specifier.alias("specifier"))

    return (
        F.when(node.startswith(FILE), parsed("file", path=F.substring(node, 6, 1 << 30)))
        .when(node.startswith(SYMBOL) & node.contains("#"), parsed("sym", path=F.substring_index(rest, "#", 1), name=_after(rest, "#")))
        .when(node.startswith(EXTERNAL) & rest.contains(":"), parsed("ext", language=F.substring_index(rest, ":", 1), specifier=_after(rest, ":")))
    )


def parse_target(target: Column) -> Column:
    """struct<node_id, path, symbol>: an id as it is, else path#symbol cut at the last # (unless that comes first), else
    a path."""
    none = F.lit(None).cast("string")
    is_id = target.startswith(FILE) | target.startswith(SYMBOL) | target.startswith(EXTERNAL)
    cut = F.regexp_extract(target, r"(?s)^(.+)#([^#]*)$", 1)
    has = target.rlike(r"(?s)^.+#[^#]*$")
    return (
        F.when(is_id, F.struct(target.alias("node_id"), none.alias("path"), none.alias("symbol")))
        .when(has, F.struct(none.alias("node_id"), cut.alias("path"), F.regexp_extract(target, r"(?s)^(.+)#([^#]*)$", 2).alias("symbol")))
        .otherwise(F.struct(none.alias("node_id"), target.alias("path"), none.alias("symbol")))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def group_hash(ids: Column) -> Column:
    """Stable id of a cyclic group from its ids in order: times 33 plus each character, in 32 bits, over the ids joined
    by bars."""
    chars = F.split(F.array_join(ids, "|"), "")
    value = F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 33 + F.ascii(c)).bitwiseAND(F.lit(4294967295))))
    return F.concat(F.lit("scc-"), F.lower(F.hex(value)))


def encode_cursor(offset: Column) -> Column:
    text = F.base64(offset.cast("string").cast("binary"))
    return F.rtrim(F.translate(F.translate(text, "+/", "-_"), "=", " "))


def decode_cursor(cursor: Column) -> Column:
    """The offset in a cursor; 0 for anything that holds none."""
    text = F.translate(F.regexp_replace(cursor, "[^A-Za-z0-9_\\-+/]", ""), "-_", "+/")
    pad = F.pmod(-F.length(text), F.lit(4))
    # A remainder of one character encodes nothing.
    whole = F.when(pad == 3, F.lit("")).otherwise(F.concat(text, F.repeat(F.lit("="), pad)))
    number = F.regexp_extract(F.unbase64(whole).cast("string"), r"^\s*\+?(\d{1,18})", 1)
    return F.coalesce(F.when(number != "", number).try_cast("long"), F.lit(0).cast("long"))


def package_name(spec: Column) -> Column:
    """npm package of an import specifier: the first part, or the first two of a scoped one."""
    return F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def package_of_path(path: Column) -> Column:
    """npm package of a file under node_modules (the innermost); the path itself if it is under none."""
    path = slashes(path)
    return F.when(path.contains("node_modules/"), package_name(F.substring_index(path, "node_modules/", -1))).otherwise(path)


def framework_name(spec: Column) -> Column:
    """Framework of an angled include: what comes before the first slash, else the name without .h."""
    return F.when(F.instr(spec, "/") > 1, F.substring_index(spec, "/", 1)).otherwise(F.regexp_replace(spec, r"\.h$", ""))


def glob_regex(glob: str) -> str:
    """A glob as an unanchored pattern: ** any text (with a slash that follows), * and ? within one name."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob.replace("\\", "/"))
    known = {"*": "[^/]*", "?": "[^/]"}
    return "".join(".*" if p.startswith("**") else known.get(p) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in parts)


def ignored(path: Column, globs: tuple[str, ...] = IGNORED) -> Column:
    path, out = slashes(path), F.lit(False)
    for glob in globs:
        out = out | path.rlike(glob_regex(glob))
    return out


def relative_import(text: Column) -> Column:
    """struct<level, submodule> of a Python import path: its leading dots, and the rest or null."""
    rest = F.regexp_extract(text, r"(?s)^\.*(.*)$", 1)
    level = F.length(text) - F.length(rest)
    return F.struct(level.alias("level"), F.when(rest != "", rest).alias("submodule"))


def is_within(path: Column, root: Column) -> Column:
    path, root = (F.regexp_replace(slashes(c), "/$", "") for c in (path, root))
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def looks_cpp(text: Column) -> Column:
    out = F.lit(False)
    for sign in CPP_SIGNS:
        out = out | text.rlike(sign)
    return out


def under_prefix(node_kind_: Column, name: Column, file: Column, prefix: str) -> Column:
    """Nodes whose file's path begins with prefix; externals never do."""
    return F.when(node_kind_ == "file", name.startswith(prefix)).when(node_kind_ == "symbol", F.coalesce(file, F.lit("")).startswith(prefix)).otherwise(F.lit(False))
