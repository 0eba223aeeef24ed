"""Objective-C: interfaces, protocols, categories, macros, forward declarations; module imports and includes."""

from __future__ import annotations

import re

from . import Fragment, Import, Reference, Symbol
from .cpp import search_files
from .lexer import C_LIKE, Source

EXTENSIONS = (".m", ".mm")
#: What makes a header Objective-C.
MARKS = re.compile(r"^[ \t]*(?:@interface|@protocol|@implementation|@class|@import|#[ \t]*import)\b", re.M)

_INTERFACE = re.compile(r"@interface\s+(?P<name>\w+)\s*(?:<[^>]*>\s*)?(?:\(\s*(?P<category>\w*)\s*\))?")
_IMPLEMENTATION = re.compile(r"@implementation\s+(?P<name>\w+)\s*\(\s*(?P<category>\w+)\s*\)")
_PROTOCOL = re.compile(r"@protocol\s+(\w+)(?!\s*[;,\w])")
_FORWARD = re.compile(r"@class\s+([\w\s,<>]+);")
_DEFINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)", re.M)
_INCLUDE = re.compile(r"^[ \t]*#[ \t]*(?:import|include)[ \t]*(\"[^\"\n]*\"|<[^>\n]*>)", re.M)
_MODULE = re.compile(r"@import\s+([\w.]+)\s*;")


def framework(spec: str) -> str:
    return spec[: spec.index("/")] if spec.find("/") > 0 else spec.removesuffix(".h")


def analyze(path: str, text: str, config: dict) -> Fragment:
    """config: include_dirs. A category refers to its class, and so does its implementation, for the file; which file
    declares the class is found by name."""
    s = Source(text, C_LIKE)
    out = Fragment("objc")
    for m in _INTERFACE.finditer(s.code):
        line, col = s.place(m.start("name"))
        if m["category"]:
            name = f"{m['name']}({m['category']})"
            out.symbols.append(Symbol(name, "class", line, col))
            out.references.append(Reference(m["name"], line, col, target=f"sym:?#{m['name']}", source=name))
        elif m["category"] is None:
            out.symbols.append(Symbol(m["name"], "class", line, col))
    out.symbols += [Symbol(m[1], "protocol", *s.place(m.start(1))) for m in _PROTOCOL.finditer(s.code)]
    out.symbols += [Symbol(m[1], "macro", *s.place(m.start(1))) for m in _DEFINE.finditer(s.code)]
    for m in _IMPLEMENTATION.finditer(s.code):
        out.references.append(Reference(m["name"], *s.place(m.start("name")), target=f"sym:?#{m['name']}"))
    for m in _FORWARD.finditer(s.code):
        for name in re.finditer(r"(?:^|,)\s*(\w+)", m[1]):
            out.references.append(Reference(name[1], *s.place(m.start(1) + name.start(1)), target=f"sym:?#{name[1]}"))
    out.symbols.sort(key=lambda x: (x.line, x.col))
    for m in _INCLUDE.finditer(s.bare):
        spec, quoted = m[1][1:-1], m[1][0] == '"'
        out.imports.append(Import(spec, *s.place(m.start(1)), search_files(spec, path, quoted, config), f"ext:objc:{framework(spec)}"))
    for m in _MODULE.finditer(s.code):
        out.imports.append(Import(m[1], *s.place(m.start(1)), [], f"ext:objc:{m[1]}", wildcard=True))
    out.imports.sort(key=lambda i: (i.line, i.col))
    return out
