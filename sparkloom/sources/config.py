"""Project configuration that analyzers need, read on the driver from a checked-out tree."""

from __future__ import annotations

import configparser
import json
import os
import re
import shlex
import tomllib
from pathlib import Path

from .analyzers.rust import STANDARD


def _text(path: Path) -> str | None:
    try:
        return path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def _relative(root: Path, path: str) -> str:
    rel = os.path.relpath(os.path.join(root, path), root).replace("\\", "/")
    return "" if rel == "." else rel


def python_roots(root: Path, explicit: list[str] | None = None) -> list[str]:
    """Folders of top-level modules: given ones, else what pyproject.toml says, else setup.cfg, else the repo."""
    if explicit:
        return [_relative(root, r) for r in explicit if isinstance(r, str)]
    try:
        tools = tomllib.loads(_text(root / "pyproject.toml") or "").get("tool", {}).get("setuptools", {})
    except tomllib.TOMLDecodeError:
        tools = {}
    where = (tools.get("packages") or {}).get("find", {}).get("where") if isinstance(tools.get("packages"), dict) else None
    if isinstance(where, list) and where:
        return [_relative(root, w) for w in where if isinstance(w, str)]
    folder = tools.get("package-dir") or {}
    if isinstance(folder.get("", folder.get("*")), str):
        return [_relative(root, folder.get("", folder.get("*")))]
    cfg = configparser.ConfigParser(delimiters=("=",), strict=False)
    try:
        cfg.read_string(_text(root / "setup.cfg") or "")
        value = cfg.get("options", "package_dir", fallback="").strip()
    except configparser.Error:
        value = ""
    if value:
        first = value.splitlines()[0]
        return [_relative(root, first.partition("=")[2].strip() or first.strip(" ="))]
    return [""]


def _json(text: str | None) -> dict:
    """JSON that may hold comments and trailing commas."""
    if not text:
        return {}
    text = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    try:
        out = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def typescript(root: Path, tsconfig: str | None = None) -> dict:
    """base_url and paths of tsconfig.json (with what it extends), and the packages that package.json names."""
    options: dict = {}
    at, seen = root / (tsconfig or "tsconfig.json"), set()
    while at.is_file() and at not in seen:
        seen.add(at)
        config = _json(_text(at))
        own = config.get("compilerOptions") or {}
        folder = os.path.relpath(at.parent, root)
        if "base_url" not in options and isinstance(own.get("baseUrl"), str):
            options["base_url"] = _relative(root, os.path.join(folder, own["baseUrl"]))
        if "paths" not in options and isinstance(own.get("paths"), dict):
            options["paths"] = {k: [t for t in v if isinstance(t, str)] for k, v in own["paths"].items() if isinstance(v, list)}
            options["paths_base"] = _relative(root, folder)
        parent = config.get("extends")
        if not isinstance(parent, str) or not parent.startswith("."):
            break
        at = at.parent / (parent if parent.endswith(".json") else f"{parent}.json")
    package = _json(_text(root / "package.json"))
    names = {n for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for n in package.get(part) or {}}
    return options | {"packages": sorted(names)}


def cargo(root: Path) -> dict:
    """crate_name, crate_root, more_roots and crates (dependencies, also with _ for -) of Cargo.toml."""
    try:
        manifest = tomllib.loads(_text(root / "Cargo.toml") or "")
    except tomllib.TOMLDecodeError:
        manifest = {}
    lib = (manifest.get("lib") or {}).get("path") or ("src/lib.rs" if (root / "src/lib.rs").is_file() else None)
    bins = []
    for b in manifest.get("bin") or []:
        bins.append(b["path"] if "path" in b else f"src/bin/{b['name']}.rs" if "name" in b else "src/main.rs")
    if not bins and lib is None and (root / "src/main.rs").is_file():
        bins = ["src/main.rs"]
    roots = [_relative(root, r) for r in ([lib] if lib else []) + bins] or ["src/main.rs"]
    names = {n for part in ("dependencies", "dev-dependencies", "build-dependencies") for n in manifest.get(part) or {}}
    crates = sorted({*STANDARD, *names, *(n.replace("-", "_") for n in names)})
    return {"crate_name": (manifest.get("package") or {}).get("name") or root.resolve().name, "crate_root": roots[0], "more_roots": roots[1:], "crates": crates}


def compile_flags(arguments: list[str], folder: str) -> tuple[list[str], dict[str, str]]:
    """Include folders (absolute) and defines of a compiler call; values may follow their flag or be joined to it."""
    dirs, defines = [], {}
    rest = iter(arguments)
    for a in rest:
        for flag in ("-isystem", "-isysroot", "-I", "-D"):
            if a.startswith(flag):
                value = a[len(flag) :] or next(rest, "")
                if flag == "-D":
                    name, _, set_to = value.partition("=")
                    defines[name] = set_to or "1"
                elif value:
                    dirs.append(os.path.normpath(os.path.join(folder, value)))
                break
    return dirs, defines


def includes(root: Path, file: str | None = None, given: list[str] | None = None) -> dict:
    """include_dirs (repo-relative) and defines: from compile_commands.json (the file's entry, else the first), else
    from CMakeLists.txt, then the given ones; include, src and inc only if there are no others."""
    dirs: list[str] = []
    defines: dict[str, str] = {}
    found = False
    for at in (root / "compile_commands.json", root / "build/compile_commands.json"):
        try:
            commands = json.loads(_text(at) or "[]")
        except ValueError:
            continue
        if isinstance(commands, list) and commands:
            absolute = lambda c: os.path.normpath(os.path.join(c.get("directory", ""), c.get("file", "")))
            entry = next((c for c in commands if file and (c.get("file") == file or absolute(c) == str(root / file))), commands[0])
            arguments = entry.get("arguments") or shlex.split(entry.get("command") or "")
            dirs, defines = compile_flags(arguments, os.path.join(root, entry.get("directory", "")))
            found = True
            break
    if not found:
        text = re.sub(r"#[^\n]*", "", _text(root / "CMakeLists.txt") or "")
        for call in re.finditer(r"\b(?:target_)?include_directories\s*\(([^)]*)\)", text, re.I):
            words = call[1].split()
            words = words[1:] if call[0].lower().startswith("target_") else words
            for w in words:
                w = re.sub(r"\$\{(?:CMAKE_(?:CURRENT_)?SOURCE_DIR|PROJECT_SOURCE_DIR)\}", str(root), w.strip('"'))
                if w.upper() not in ("PUBLIC", "PRIVATE", "INTERFACE", "SYSTEM", "BEFORE", "AFTER") and "$" not in w:
                    dirs.append(os.path.join(root, w))
    dirs += [os.path.join(root, d) for d in given or ()]
    if not dirs:
        dirs = [str(root / d) for d in ("include", "src", "inc") if (root / d).is_dir()]
    return {"include_dirs": list(dict.fromkeys(_relative(root, d) for d in dirs)), "defines": defines}


def read(root: str | Path) -> dict[str, dict]:
    """Configuration of all analyzers, by language group."""
    root = Path(root)
    return {"python": {"source_roots": python_roots(root)}, "script": typescript(root), "rust": cargo(root), "cpp": includes(root), "objc": includes(root)}
