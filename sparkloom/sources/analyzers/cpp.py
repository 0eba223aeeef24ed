"""C and C++: includes everywhere, declarations at the top level (and inside namespaces and extern blocks).

Conditional parts all count. Declarations are read statement by statement from the text without comments and strings.
"""

from __future__ import annotations

import posixpath
import re

from ...functions.ids import CPP_SIGNS
from . import Fragment, Import, Symbol
from .lexer import C_LIKE, Source, join

CPP, C, HEADERS = (".cpp", ".cxx", ".cc", ".c++", ".mm"), (".c", ".m"), (".h", ".hpp", ".hxx", ".h++", ".hh")
EXTENSIONS = (*CPP[:-1], ".c", *HEADERS)

_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*(\"[^\"\n]*\"|<[^>\n]*>)", re.M)
_DEFINE = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)", re.M)
_NOT_NAMES = {"if", "for", "while", "switch", "return", "sizeof", "alignas", "decltype", "noexcept", "throw", "__attribute__", "__declspec", "defined", "static_assert", "case", "else", "do", "asm"}


def language(path: str, text: str) -> str:
    ext = posixpath.splitext(path)[1].lower()
    if ext in CPP:
        return "cpp"
    return "cpp" if ext in HEADERS and any(re.search(p, text) for p in CPP_SIGNS) else "c"


def search_files(spec: str, path: str, quoted: bool, config: dict) -> list[str]:
    """Files an include may mean: beside the file if quoted, then each include folder."""
    dirs = ([posixpath.dirname(path)] if quoted else []) + list(config.get("include_dirs") or ())
    return [join(d, spec) for d in dirs]


def includes(s: Source, path: str, config: dict) -> list[Import]:
    out = []
    for m in _INCLUDE.finditer(s.bare):
        spec = m[1][1:-1]
        out.append(Import(spec, *s.place(m.start(1)), search_files(spec, path, m[1][0] == '"', config), f"ext:{spec}"))
    return out


def _without_directives(code: str) -> str:
    """Directives (with continued lines) as spaces."""
    return re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.M | re.S)


def declarator(text: str) -> tuple[str, int] | None:
    """The name that a declarator such as *a[3], (*f)(int) or X::g(...) declares, and its place in the text."""
    text = re.split(r"(?<![=!<>])=(?!=)", text, maxsplit=1)[0] if "operator" not in text else text
    if m := re.search(r"\boperator\s*(?:\(\)|\[\]|[^\s\w(]+|\w+)", text):
        return re.sub(r"\s+", "", m[0]) if re.search(r"operator\s*\W", m[0]) else m[0], m.start()
    if m := re.search(r"\(\s*[*&^]\s*(?:const\s+)?(\w+)", text):
        return m[1], m.start(1)
    head = re.split(r"[(\[{]", text, maxsplit=1)[0]
    m = re.search(r"(~?\s*[A-Za-z_]\w*)\s*(?::\s*\d+\s*)?$", head.rstrip())
    return (re.sub(r"\s", "", m[1]), m.start(1)) if m and m[1] not in _NOT_NAMES else None


def declarations(s: Source, cpp: bool) -> list[Symbol]:
    found: list[tuple[int, str, str]] = [(m.start(1), m[1], "macro") for m in _DEFINE.finditer(s.code)]
    code = _without_directives(s.code)
    plain = Source("", C_LIKE)
    plain.code = code

    def block(at: int, end: int) -> None:
        start = at
        while at < end:
            c = code[at]
            if c in ";":
                statement(start, at, None)
                start = at = at + 1
            elif c in "([":
                at = min(end, plain.closing(at) + 1)
            elif c == "{":
                close = plain.closing(at)
                head = code[start:at]
                if re.search(r"\b(?:namespace|extern)\b[^()]*$", head) and (cpp or "extern" in head):
                    if m := re.search(r"\bnamespace\s+(\w+(?:::\w+)*)\s*$", head):
                        found.append((start + m.start(1), m[1], "module"))
                    block(at + 1, min(close, end))
                    start = at = close + 1
                elif "=" in re.sub(r"operator\s*\S+|[<>!=]=", "", head) or re.search(r"\b(?:struct|union|enum|class)\b[^()=;]*$", head):
                    at = close + 1  # an initialiser or a body that a declarator may follow
                else:
                    statement(start, at, at)
                    start = at = close + 1
            elif c == "}":
                start = at = at + 1
            else:
                at += 1

    def statement(a: int, b: int, body: int | None) -> None:
        text = code[a:b]
        lead = len(text) - len(text.lstrip())
        a, text = a + lead, text.strip()
        while cpp and (m := re.match(r"template\s*<", text)):
            depth, i = 0, m.end() - 1
            for i in range(m.end() - 1, len(text)):
                depth += {"<": 1, ">": -1}.get(text[i], 0)
                if depth == 0:
                    break
            rest = text[i + 1 :]
            a, text = a + i + 1 + len(rest) - len(rest.lstrip()), rest.strip()
        if not text or re.match(r"(?:using|friend|static_assert|public|private|protected|return|@)\b|@", text):
            return
        if m := re.match(r"(typedef\s+)?(?:(?:static|extern|inline|constexpr|const|volatile)\s+)*(struct|union|enum|class)\b(?:\s+(?:class|struct))?(?:\s*(?:alignas\s*\([^)]*\)|\[\[[^\]]*\]\]|__attribute__\s*\(\(.*?\)\)))*\s*(\w+)?", text):
            brace = text.find("{")
            typedef, word, name = m.groups()
            if brace >= 0 or not text[m.end() :].strip():
                rest = text[_closing(text, brace) + 1 :].strip() if brace >= 0 else ""
                kind = {"struct": "struct", "union": "struct", "enum": "enum", "class": "class"}[word]
                if name and not typedef and not rest and (word != "class" or cpp):
                    found.append((a + m.start(3), name, kind))
                if typedef and rest:
                    several(a + len(text) - len(rest), rest, "type")
                elif rest:
                    several(a + len(text) - len(rest), rest, "variable")
                return
        if m := re.match(r"typedef\s+", text):
            several(a + m.end(), text[m.end() :], "type", typed=True)
            return
        if body is not None:
            head = re.split(r"\)\s*:(?!:)", text, maxsplit=1)[0] + (")" if re.search(r"\)\s*:(?!:)", text) else "")
            if "(" in head and (d := declarator(head)) and d[0] not in _NOT_NAMES:
                found.append((a, d[0], "function"))
            return
        several(a, text, "variable", typed=True)

    def several(a: int, text: str, kind: str, typed: bool = False) -> None:
        """Declarators between commas; with `typed` the first follows a type."""
        depth, start = 0, 0
        for i, c in enumerate([*text, ","]):
            if c in "([{<":
                depth += 1
            elif c in ")]}>":
                depth = max(0, depth - 1)
            elif c == "," and depth == 0:
                part = text[start:i]
                if (d := declarator(part)) and (start or not typed or re.search(r"[\w*&>\s]", part[: d[1]].strip()[-1:] or "")):
                    at = d[1]
                    back = re.search(r"[*&(\s]*$", part[:at])
                    stars = back[0].lstrip()
                    found.append((a + start + at - len(stars), d[0], kind))
                start = i + 1

    block(0, len(code))
    return [Symbol(name, kind, *s.place(at), suffix="_") for at, name, kind in sorted(found, key=lambda x: x[0])]


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return len(text)


def analyze(path: str, text: str, config: dict) -> Fragment:
    """config: include_dirs, repo-relative folders in order."""
    s = Source(text, C_LIKE)
    lang = language(path, text)
    return Fragment(lang, declarations(s, lang == "cpp"), includes(s, path, config))
