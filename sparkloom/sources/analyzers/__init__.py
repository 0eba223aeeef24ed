"""Analyzers: what each language's text declares, imports and refers to, as plain records.

An analyzer is a function of (path, text, config) that never touches the disk: an import names its candidate files in
order, and which of them exist is decided later by a join with the list of files. Locations have lines from 1 and
columns from 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    line: int
    col: int
    exported: bool = True
    suffix: str = "~"  # before the number of a repeated name
    numbered: bool = True


@dataclass
class Import:
    specifier: str
    line: int
    col: int
    candidates: list[str] = field(default_factory=list)  # repo-relative paths, first wins
    otherwise: str | None = None  # target if no candidate exists
    resolution: str = "unresolved"  # of `otherwise`
    wildcard: bool = False
    type_only: bool = False


@dataclass
class Reference:
    """A use of a name that another file declares: `name` (* for the file itself) of the first candidate that exists,
    or a target id as it is."""

    name: str
    line: int
    col: int
    candidates: list[str] = field(default_factory=list)
    target: str | None = None
    source: str | None = None  # symbol of this file that refers; None: the file
    type_only: bool = False


@dataclass
class Export:
    """`name` of this file stands for `of`: a symbol of it (no candidates), or `of` of the first candidate that exists;
    name * passes on everything."""

    name: str
    of: str
    candidates: list[str] = field(default_factory=list)


@dataclass
class Fragment:
    language: str
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)
    exports: list[Export] = field(default_factory=list)
