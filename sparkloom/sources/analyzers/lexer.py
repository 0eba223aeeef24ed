"""Blanking of comments and strings, brace depth and places, for languages without a parser at hand."""

from __future__ import annotations

import bisect
import posixpath
import re


class Source:
    """A text with its comments (and, in `code`, also the insides of its strings) turned into spaces; places stay."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        code, bare = [], []
        at = 0
        for m in pattern.finditer(text):
            between, found = text[at : m.start()], m.group()
            code.append(between)
            bare.append(between)
            blank = re.sub(r"[^\n]", " ", found)
            if m.lastgroup == "comment":
                code.append(blank)
                bare.append(blank)
            else:
                code.append(found[0] + blank[1:-1] + found[-1] if len(found) > 1 else found)
                bare.append(found)
            at = m.end()
        self.code = "".join(code) + text[at:]
        self.bare = "".join(bare) + text[at:]  # strings as they are

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1, column from 0."""
        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def depths(self) -> list[int]:
        """Depth of braces, brackets and parentheses before each character of code, and after the last."""
        out, depth = [], 0
        for c in self.code:
            out.append(depth)
            if c in "{([":
                depth += 1
            elif c in "})]":
                depth = max(0, depth - 1)
        out.append(depth)
        return out

    def closing(self, at: int) -> int:
        """Place of the bracket that closes the one at `at`; the end if none does."""
        depth = 0
        for i in range(at, len(self.code)):
            c = self.code[i]
            if c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
                if depth == 0:
                    return i
        return len(self.code)


#: Comments and strings of the C family; a raw or template string may span lines.
C_LIKE = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
SCRIPT = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
#: A quote that no quote closes nearby is a lifetime, not a character.
RUST = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|r(#*)\".*?\"\2|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S)


def join(*parts: str) -> str:
    """A repo-relative path; one that leaves the repo begins with .. and exists in no list of files."""
    path = posixpath.normpath(posixpath.join(*[p for p in parts if p] or ["."]))
    return "" if path == "." else path
