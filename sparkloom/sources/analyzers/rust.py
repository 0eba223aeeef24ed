"""Rust: items, modules and use trees at the top level of a file."""

from __future__ import annotations

import posixpath
import re

from . import Fragment, Import, Symbol
from .lexer import RUST, Source, join

EXTENSIONS = (".rs",)
#: Crates that every project has.
STANDARD = ("std", "core", "alloc", "proc_macro", "test")

_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "variable", "static": "variable"}
_ITEM = re.compile(
    r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern(?:\s*\"[^\"]*\")?|const(?=\s+(?:unsafe\s+|extern\s+|async\s+)*fn\b))\s+)*"
    r"(?:(?P<kind>fn|struct|enum|trait|type|const|static|mod|use)\b\s*(?:mut\s+)?|(?P<macro>macro_rules)\s*!\s*)(?P<rest>r#\w+|\w+)?"
)


def uses(tree: str) -> list[tuple[list[str], bool]]:
    """(segments, wildcard) of every path of a use tree: a::{b, c::d as e, self}, f::*."""
    out = []

    def walk(text: str, prefix: list[str]) -> None:
        text = text.strip()
        if not text:
            return
        if (brace := text.find("{")) >= 0:
            head = [p.strip() for p in text[:brace].split("::") if p.strip()]
            depth, start, inner = 0, 0, text[brace + 1 : text.rfind("}")]
            for i, c in enumerate([*inner, ","]):
                depth += (c == "{") - (c == "}")
                if c == "," and depth == 0:
                    walk(inner[start:i], prefix + head)
                    start = i + 1
            return
        parts = [p.strip() for p in re.split(r"\s+as\s+", text)[0].split("::") if p.strip()]
        if parts and parts[-1] == "*":
            out.append((prefix + parts[:-1], True))
        elif parts:
            out.append((prefix + parts, False))

    walk(tree, [])
    return out


def module_files(folder: str, segments: list[str]) -> list[str]:
    base = join(folder, *segments)
    return [f"{base}.rs", join(base, "mod.rs")]


def target(segments: list[str], path: str, config: dict) -> tuple[list[str], str, str]:
    """Candidate files, and the external target and its resolution if none of them exists."""
    name, root = config.get("crate_name", "crate"), config.get("crate_root", "src/main.rs")
    first, rest = segments[0], segments[1:]
    folder = posixpath.dirname(path)
    base = {"crate": posixpath.dirname(root), "super": posixpath.dirname(folder), "self": folder}.get(first)
    if base is None:
        known = first in STANDARD or first in (config.get("crates") or ())
        return [], f"ext:rust:{'::'.join(segments)}", "resolved" if known else "unresolved"
    if not rest:
        return [root] if first == "crate" else [join(base, "mod.rs")], f"file:<unresolved>/{first}", "unresolved"
    files = module_files(base, rest) + (module_files(base, rest[:-1]) if len(rest) > 1 else [])
    return files, f"ext:rust:{'::'.join([name, *rest])}", "unresolved"


def analyze(path: str, text: str, config: dict) -> Fragment:
    """config: crate_name, crate_root, crates (names of the manifest's dependencies, also with _ for -)."""
    s = Source(text, RUST)
    out = Fragment("rust")
    depth, at = s.depths(), 0
    while m := _ITEM.search(s.code, at):
        at = m.end()
        if depth[m.start()] or (m.start() and (s.code[m.start() - 1].isalnum() or s.code[m.start() - 1] in "_#:.")):
            at = m.start() + 1 if depth[m.start()] else at
            continue
        line, col = s.place(m.start())
        kind, name = m["kind"], (m["rest"] or "").removeprefix("r#")
        if kind == "use":
            end = s.code.find(";", m.end("kind"))
            end = len(s.code) if end < 0 else end
            for segments, star in uses(s.code[m.end("kind") : end]):
                if segments:
                    files, otherwise, resolution = target(segments, path, config)
                    out.imports.append(Import("::".join(segments), line, col, files, otherwise, resolution, wildcard=star))
            at = end
        elif kind == "mod" and name:
            if re.match(r"\s*\{", s.code[m.end() :]):
                out.symbols.append(Symbol(name, "module", line, col, exported=False, numbered=False))
            else:
                out.imports.append(Import(f"mod {name}", line, col, module_files(posixpath.dirname(path), [name]), f"file:<unresolved>/{path}::{name}"))
        elif name and (m["macro"] or name != "_"):
            out.symbols.append(Symbol(name, "macro" if m["macro"] else _KINDS[kind], line, col, exported=bool(m["vis"])))
    return out
