"""Python: definitions and imports from the syntax tree."""

from __future__ import annotations

import ast
import re

from . import Fragment, Import, Reference, Symbol
from .lexer import join

EXTENSIONS = (".py", ".pyi")


def module_files(root: str, dotted: str) -> list[str]:
    base = join(root, dotted.replace(".", "/"))
    return [f"{base}.py", join(base, "__init__.py")]


def _definitions(tree: ast.Module) -> list[Symbol]:
    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((node.name, "function", node))
        elif isinstance(node, ast.ClassDef):
            out.append((node.name, "class", node))
        elif isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign):
            # Only a single plain name on the left, as in x = y = 1, whose first name counts.
            left = node.targets[0] if isinstance(node, ast.Assign) else node.target
            if isinstance(left, ast.Name) and not isinstance(node, ast.AugAssign):
                out.append((left.id, "variable", left))
    return [Symbol(n, k, *_name_place(node), exported=not n.startswith("_") or (n.startswith("__") and n.endswith("__"))) for n, k, node in out]


def _name_place(node: ast.AST) -> tuple[int, int]:
    if isinstance(node, ast.Name):
        return node.lineno, node.col_offset
    skip = {"FunctionDef": 4, "AsyncFunctionDef": 10, "ClassDef": 6}[type(node).__name__]
    return node.lineno, node.col_offset + skip


_FAULTS = (SyntaxError, ValueError, RecursionError, MemoryError)
_STRING = re.compile(r"#[^\n]*|(?P<long>\"{3}|'{3})(?:\\.|(?!(?P=long)).)*+(?:(?P=long)|\Z)|\"(?:\\.|[^\"\\\n])*+\"?|'(?:\\.|[^'\\\n])*+'?", re.S)
_GOES_ON = re.compile(r"[\s#)\]}]|(?:else|elif|except|finally)\b|\Z")
_HEADER = re.compile(r"(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")
_IMPORTS = re.compile(r"[ \t]*(?:import|from)\s")


def _parsed(text: str, line: int, col: int) -> list[ast.stmt]:
    """The statements of a piece of a file that begins at a place there; none if it can't be parsed."""
    try:
        body = ast.parse(text).body
    except _FAULTS:
        return []
    for statement in body:
        ast.increment_lineno(statement, line - 1)
        for node in ast.walk(statement) if col else ():
            if hasattr(node, "col_offset"):
                node.col_offset += col
    return body


def _tolerant(text: str) -> ast.Module:
    """The tree of a text with faults: each statement at the left margin stands or falls alone. Of a definition that can't
    be parsed its name stays, and of any statement its lines that import. Linear in the text."""
    lines = text.split("\n")
    quoted, at = set(), 0  # lines that begin inside a string
    breaks = [0]
    for n in lines:
        breaks.append(breaks[-1] + len(n) + 1)
    for m in _STRING.finditer(text):
        while breaks[at] <= m.start():
            at += 1
        while at < len(lines) and breaks[at] < m.end():
            quoted.add(at)
            at += 1
    starts = [k for k, n in enumerate(lines) if k not in quoted and not _GOES_ON.match(n)]
    starts = [k for i, k in enumerate(starts) if not (i and lines[starts[i - 1]].startswith("@"))]
    body: list[ast.stmt] = []
    for k, end in zip(starts, [*starts[1:], len(lines)], strict=False):
        if whole := _parsed("\n".join(lines[k:end]), k + 1, 0):
            body += whole
            continue
        head = next((i for i in range(k, end) if i not in quoted and not lines[i].startswith("@")), k)
        if m := _HEADER.match(lines[head]):
            body += _parsed(m.group() + ("(): pass" if m["kind"] == "def" else ": pass"), head + 1, 0)
        i = k
        while i < end:
            own = lines[i]
            indent = len(own) - len(own.lstrip())
            last = i
            if i not in quoted and _IMPORTS.match(own):
                while "(" in own and ")" not in lines[last] and last + 1 < end:
                    last += 1
                body += _parsed("\n".join([own.lstrip(), *lines[i + 1 : last + 1]]), i + 1, indent) or _parsed(own.lstrip(), i + 1, indent)
            i = last + 1
    return ast.Module(body, [])


def analyze(path: str, text: str, config: dict) -> Fragment:
    """config: source_roots, repo-relative folders that absolute imports are looked for in (default: the repo).

    An import of a module that no root has is external, by its first name. Of text with faults, or for another version
    of Python, all statements count that can be parsed.
    """
    out = Fragment("python")
    try:
        tree = ast.parse(text)
    except _FAULTS:
        tree = _tolerant(text)
    roots = config.get("source_roots") or [""]
    out.symbols = _definitions(tree)
    lines = text.split("\n")
    bound: dict[str, tuple[list[str], str]] = {}
    statements = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)), key=lambda n: (n.lineno, n.col_offset))
    for node in statements:
        if isinstance(node, ast.Import):
            for a in node.names:
                files = [f for r in roots for f in module_files(r, a.name)]
                out.imports.append(Import(a.name, a.lineno, a.col_offset, files, f"ext:{a.name.split('.')[0]}", "resolved"))
                bound.setdefault((a.asname or a.name).split(".")[0], (files, "*"))
            continue
        module = node.module or ""
        m = re.compile(r"\s*from\s+").match(lines[node.lineno - 1], node.col_offset) if node.lineno <= len(lines) else None
        col = m.end() if m else node.col_offset + 5
        star = any(a.name == "*" for a in node.names)
        if node.level:
            folder = join(path, "..", *[".."] * (node.level - 1))
            files = module_files(folder, module) if module else [join(folder, "__init__.py")]
            spec = "." * node.level + module
            out.imports.append(Import(spec, node.lineno, col, files, f"unresolved:{spec}", "unresolved", wildcard=star))
        else:
            files = [f for r in roots for f in module_files(r, module)]
            for spec in [module] if star else [f"{module}.{a.name}" for a in node.names]:
                out.imports.append(Import(spec, node.lineno, col, files, f"ext:{module.split('.')[0]}", "resolved", wildcard=star))
        for a in node.names:
            if a.name != "*":
                bound.setdefault(a.asname or a.name, (files, a.name))
    seen = set()
    uses = [n for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in bound]
    for n in sorted(uses, key=lambda n: (n.lineno, n.col_offset)):
        if n.id not in seen:
            seen.add(n.id)
            files, name = bound[n.id]
            out.references.append(Reference(name, n.lineno, n.col_offset, files))
    return out
