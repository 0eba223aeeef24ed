"""TypeScript and JavaScript: top-level declarations, imports and exports, and uses of what is imported.

Declarations are found by keyword at depth 0 of the text without comments and strings. A use of an imported name refers
to what the name stands for; through how many files of re-exports is decided by joins later. Names that only a type
checker could follow (members of values, inferred types) are out of reach.
"""

from __future__ import annotations

import re

from . import Export, Fragment, Import, Reference, Symbol
from .lexer import SCRIPT, Source, join

EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
TYPED = (".ts", ".tsx", ".mts", ".cts")

_NAME = r"[A-Za-z_$][\w$]*"
_KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "module", "module": "module", "const": "variable", "let": "variable", "var": "variable"}
_DECLARE = re.compile(
    rf"(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?:const\s+)?(?P<enum>enum)|(?P<kind>function|class|interface|type|namespace|module|const|let|var))\b\s*\*?\s*(?P<name>{_NAME})?"
)
_IMPORT = re.compile(r"import\s*(?P<type>type\b(?!\s*(?:,|from\b))\s*)?(?P<clause>[^'\"`;()]*?)\s*(?:\bfrom\s*)?(?P<spec>['\"][^'\"\n]*['\"])")
_EXPORT = re.compile(r"export\s*(?P<type>type\s*)?(?P<clause>\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*(?:from\s*(?P<spec>['\"][^'\"\n]*['\"]))?")
_RENAMED = re.compile(rf"(?:type\s+)?(?P<of>{_NAME})(?:\s+as\s+(?P<name>{_NAME}))?")


def language(path: str) -> str:
    return "ts" if path.endswith(TYPED) else "js"


def package_name(spec: str) -> str:
    return "/".join(spec.split("/")[: 2 if spec.startswith("@") else 1])


_TYPE_BODY, _COLON, _PLAIN = re.compile(r"\s*[=<]"), re.compile(r"\s*:(?!:)"), re.compile(_NAME)
#: What stands before a name that is used as a type; what begins a new statement on the next line.
_TYPED = re.compile(r"(?::|\bextends|\bimplements|\btypeof|<|\|)$")
_NEXT = re.compile(r"\s*(?:export|import|const|let|var|function|class|interface|type|enum|namespace|async|abstract|declare|return|if|for|while)\b")


def as_files(base: str) -> list[str]:
    """Files that an import of `base` may mean, in order."""
    stem, ext = re.match(r"(.*?)(\.[mc]?jsx?)?$", base).groups()
    out = [base] if base.endswith(EXTENSIONS) and not ext else []
    if ext:
        out += [f"{stem}{e}" for e in {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}[ext]] + [base]
    out += [f"{base}{e}" for e in (".ts", ".tsx", ".d.ts")]
    return out + [join(base, f"index{e}") for e in (".ts", ".tsx", ".d.ts")] + [f"{base}{e}" for e in (".js", ".jsx")] + [join(base, f"index{e}") for e in (".js", ".jsx")]


def candidates(spec: str, path: str, config: dict) -> list[str]:
    """config: base_url (repo-relative folder) and paths ({pattern with at most one *: [patterns]}), as in tsconfig."""
    if spec.startswith((".", "/")):
        return as_files(join(path, "..", spec))
    out = []
    base, aliases = config.get("base_url"), config.get("paths") or {}
    matching = []
    for pattern, targets in aliases.items():
        head, star, tail = pattern.partition("*")
        if (star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail)) or (not star and spec == pattern):
            matching.append((not star, len(head), spec[len(head) : len(spec) - len(tail)] if star else "", targets))
    if matching:
        # An exact pattern, else the one with the longest beginning.
        _, _, middle, targets = max(matching, key=lambda m: m[:2])
        for t in targets:
            out += as_files(join(base or config.get("paths_base") or "", t.replace("*", middle, 1)))
    return out + (as_files(join(base, spec)) if base is not None else [])


def prepared(config: dict) -> dict:
    """config with its packages as a set: made once for many files, as making it takes longer than a file does."""
    return config | {"packages": frozenset(config.get("packages") or ())}


def analyze(path: str, text: str, config: dict) -> Fragment:
    """config: see candidates(); packages, the names that are installed. A set of them is used as it is."""
    s = Source(text, SCRIPT)
    out = Fragment(language(path))
    depth = s.depths()
    packages = config.get("packages") or ()
    if not isinstance(packages, set | frozenset):
        packages = prepared(config)["packages"]
    taken = [False] * (len(text) + 1)  # parts of imports, re-exports and declared names: no uses
    bound: dict[str, tuple[str, str, bool]] = {}
    namespaces: dict[str, str] = {}
    files: dict[str, list[str]] = {}

    def starts_statement(at: int) -> bool:
        if depth[at]:
            return False
        while at and s.code[at - 1] in " \t":
            at -= 1
        return not at or s.code[at - 1] in "\n;}" or s.code.startswith("*/", at - 2)

    def end_before(at: int) -> int:
        """Where the text before `at` ends, white space left out."""
        while at and s.code[at - 1].isspace():
            at -= 1
        return at

    def imported(m: re.Match, type_only: bool, wildcard: bool) -> str:
        spec = m["spec"][1:-1]
        files[spec] = candidates(spec, path, config)
        package = package_name(spec)
        known = package in packages and not spec.startswith(".")
        out.imports.append(Import(spec, *s.place(m.start()), files[spec], f"ext:{package if known else spec}", "resolved" if known else "unresolved", wildcard, type_only))
        return spec

    def take(a: int, b: int) -> None:
        taken[a:b] = [True] * (b - a)

    statements = sorted([*((m, True) for m in _IMPORT.finditer(s.bare)), *((m, False) for m in _EXPORT.finditer(s.bare))], key=lambda x: x[0].start())
    for m, is_import in statements:
        if not starts_statement(m.start()) or s.code[m.start() : m.start() + 6] not in ("import", "export"):
            continue
        clause = m["clause"].strip()
        if is_import:
            spec = imported(m, bool(m["type"]), "* as" in re.sub(r"\s+", " ", clause))
            take(m.start(), m.end())
            braces = re.search(r"\{([^}]*)\}", clause)
            for r in _RENAMED.finditer(braces[1]) if braces else ():
                bound[r["name"] or r["of"]] = (spec, r["of"], bool(m["type"]))
            rest = re.sub(r"\{[^}]*\}", "", clause)
            if star := re.search(rf"\*\s*as\s+({_NAME})", rest):
                namespaces[star[1]] = spec
                rest = rest.replace(star[0], "")
            if default := re.match(rf"\s*({_NAME})", rest):
                bound[default[1]] = (spec, "default", bool(m["type"]))
            continue
        names = [(r["name"] or r["of"], r["of"]) for r in _RENAMED.finditer(clause[1:-1])] if clause[0] == "{" else []
        if m["spec"]:
            spec = imported(m, bool(m["type"]), clause == "*")
            take(m.start(), m.end())
            out.exports += [Export(n, of, files[spec]) for n, of in names] or ([Export("*", "*", files[spec])] if clause == "*" else [])
        else:
            take(m.start(), m.end())
            for name, of in names:
                if of in bound:
                    spec, inner, _ = bound[of]
                    out.exports.append(Export(name, inner, files[spec]))
                else:
                    out.exports.append(Export(name, of))
    for m in _DECLARE.finditer(s.code):
        if depth[m.start()] or taken[m.start()] or not starts_statement(m.start()):
            continue
        kind, exported = _KINDS[m["enum"] or m["kind"]], bool(m["export"])
        if kind == "variable":
            for name, at in _declarators(s, m.end("kind"), depth):
                take(at, at + len(name))
                out.symbols.append(Symbol(name, kind, *s.place(at), exported, numbered=False))
                out.exports += [Export(name, name)] if exported else []
        elif m["name"] and (kind != "type" or _TYPE_BODY.match(s.code, m.end())):
            take(m.start("name"), m.end("name"))
            out.symbols.append(Symbol(m["name"], kind, *s.place(m.start()), exported, numbered=False))
            if exported:
                out.exports.append(Export("default" if m["default"] else m["name"], m["name"]))
    for m in re.finditer(rf"export\s+default\s+({_NAME})\s*(?:;|\n|$)", s.code):
        if depth[m.start()] == 0 and m[1] not in _KINDS:
            spec = bound.get(m[1])
            out.exports.append(Export("default", spec[1], files[spec[0]]) if spec else Export("default", m[1]))
    seen = set()
    for m in re.finditer(rf"(?<![\w$.])({_NAME})(?:\s*\.\s*({_NAME}))?", s.code):
        name, member = m[1], m[2]
        if taken[m.start()] or _COLON.match(s.code, m.end()) and s.code[max(0, end_before(m.start()) - 1) : end_before(m.start())] in ("{", ","):
            continue
        hit = (namespaces[name], member) if name in namespaces and member else bound[name][:2] if name in bound else None
        if hit and hit not in seen:
            seen.add(hit)
            end = end_before(m.start())
            typed = bool(_TYPED.search(s.code[max(0, end - 12) : end])) or (name in bound and bound[name][2])
            spec = hit[0]
            package = package_name(spec)
            target = f"ext:{package}" if package in packages and not spec.startswith(".") else None
            out.references.append(Reference(hit[1], *s.place(m.start()), files[spec], target, type_only=typed))
    return out


def _declarators(s: Source, at: int, depth: list[int]) -> list[tuple[str, int]]:
    """Plain names that a const, let or var statement declares."""
    out, expect, own = [], True, depth[at]
    code = s.code
    i = at
    while i < len(code):
        c = code[i]
        if expect and not c.isspace():
            m = _PLAIN.match(code, i)
            if m:
                out.append((m[0], i))
                i = m.end()
            expect = False
            if m:
                continue
        if depth[i] == own:
            if c == ";":
                break
            if c == ",":
                expect = True
            if c == "\n" and _NEXT.match(code, i):
                break
        if depth[i] < own:
            break
        i += 1
    return out
