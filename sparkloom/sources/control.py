"""Control plane on the driver: worktree registry, confinement of paths, sessions, idle lifecycle, changed files."""

from __future__ import annotations

import itertools
import os
import subprocess
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Idle time before a worktree's overlay is dropped; the branch a worktree is compared with; git's id of
#: the empty tree.
IDLE_SECONDS = 30 * 60
BASE_BRANCH = "develop"
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


class ConfinementError(PermissionError):
    pass


def is_within(path: str, root: str) -> bool:
    path, root = (p.replace("\\", "/").removesuffix("/") for p in (path, root))
    return path == root or path.startswith(f"{root}/")


def confine_path(path: str, root: str) -> str:
    """The real path, if it (or, where it doesn't exist, its nearest existing ancestor) lies in root. A path that has
    two dots in a row anywhere after normalising is refused."""
    if ".." in os.path.normpath(path):
        raise ConfinementError(f"{path} contains '..'")
    at = Path(os.path.abspath(path))
    while not os.path.lexists(at):
        at = at.parent
    try:
        real = os.path.realpath(at, strict=True)
    except OSError:
        # A dangling link: judge by the folder it stands in.
        real = os.path.realpath(at.parent, strict=True)
    base = os.path.realpath(root, strict=True)
    if not is_within(real, base):
        raise ConfinementError(f"{real} is outside {base}")
    return real


def confine_root(root: str, allowed: list[str]) -> str:
    """The real path of an existing root that equals or lies in one of the allowed ones."""
    try:
        real = os.path.realpath(root, strict=True)
    except OSError as e:
        raise ConfinementError(f"{root} can't be read") from e
    if not any(is_within(real, os.path.realpath(a)) for a in allowed):
        raise ConfinementError(f"{real} is in no known worktree")
    return real


@dataclass
class Worktree:
    id: str
    root: str
    repo: str
    base_branch: str
    registered_at: datetime
    version: int = 0


class Registry:
    """Worktrees by id; a real path is registered once, again only renews its time (and branch, if one is given)."""

    def __init__(self, repo: str, base_branch: str = BASE_BRANCH):
        self.repo, self.base_branch = os.path.abspath(repo), base_branch
        self._numbers = itertools.count(1)
        self._by_id: dict[str, Worktree] = {}

    def register(self, root: str, base_branch: str | None = None) -> Worktree:
        if not root:
            raise ValueError("worktree root is required")
        at = os.path.abspath(os.path.join(self.repo, root))
        if not is_within(at, self.repo):
            raise ConfinementError(f"{at} escapes {self.repo}")
        try:
            real = os.path.realpath(at, strict=True)
        except OSError as e:
            raise FileNotFoundError(f"worktree root doesn't exist: {at}") from e
        if not is_within(real, os.path.realpath(self.repo)):
            raise ConfinementError(f"{real} escapes {self.repo} by a link")
        now = datetime.now(UTC)
        for w in self._by_id.values():
            if w.root == real:
                w.registered_at = now
                w.base_branch = base_branch or w.base_branch
                return w
        w = Worktree(f"wt-{next(self._numbers)}", real, self.repo, base_branch or self.base_branch, now)
        self._by_id[w.id] = w
        return w

    def get(self, worktree: str) -> Worktree | None:
        return self._by_id.get(worktree)

    def remove(self, worktree: str) -> None:
        self._by_id.pop(worktree, None)

    def all(self) -> list[Worktree]:
        return list(self._by_id.values())

    def confine(self, worktree: str, path: str) -> str:
        w = self._by_id.get(worktree)
        if w is None:
            raise KeyError(worktree)
        at = os.path.abspath(os.path.join(w.root, path))
        if not is_within(at, w.root):
            raise ConfinementError(f"{at} escapes {w.root}")
        return at


class Sessions:
    def __init__(self):
        self._bound: dict[str, str] = {}

    def bind(self, session: str, worktree: str) -> None:
        self._bound[session] = worktree

    def get(self, session: str) -> str | None:
        return self._bound.get(session)

    def unbind(self, session: str) -> None:
        self._bound.pop(session, None)

    def all(self) -> dict[str, str]:
        return dict(self._bound)


def register_worktree(registry: Registry, sessions: Sessions, root: str, base_branch: str | None = None, session: str | None = None) -> dict:
    """Registers and binds the session (its key defaults to the root); an error record if the root is refused."""
    try:
        w = registry.register(root, base_branch)
    except (OSError, ValueError) as e:
        return {"error": type(e).__name__, "message": str(e)}
    sessions.bind(session or w.root, w.id)
    return {"worktree_id": w.id, "worktree_root": w.root, "base_branch": w.base_branch}


class Lifecycle:
    """Calls on_idle(worktree) when nothing has touched it for a while; evict calls it now, cancel and close never."""

    def __init__(self, on_idle: Callable[[str], None], seconds: float = IDLE_SECONDS, timer: Callable = threading.Timer):
        self._on_idle, self._seconds, self._timer = on_idle, seconds, timer
        self._running: dict[str, object] = {}

    def touch(self, worktree: str) -> None:
        self.cancel(worktree)
        t = self._timer(self._seconds, lambda: self.evict(worktree))
        t.daemon = True
        self._running[worktree] = t
        t.start()

    def evict(self, worktree: str) -> None:
        self.cancel(worktree)
        self._on_idle(worktree)

    def cancel(self, worktree: str) -> None:
        t = self._running.pop(worktree, None)
        if t is not None:
            t.cancel()

    def close(self) -> None:
        for worktree in list(self._running):
            self.cancel(worktree)


def idle(events: DataFrame, key: str, ts: str, now: str, seconds: int = IDLE_SECONDS) -> DataFrame:
    """(key, last): keys whose last event is more than `seconds` before now (a timestamp literal). One partial
    aggregate."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS") < F.expr(f"TIMESTAMP '{now}'"))


def merge_changes(reports: DataFrame) -> DataFrame:
    """(path, status) from reports (path, source, code, present): sources are diff (committed), status (index and
    working tree) and untracked; code is git's letter; present tells if the file is there.

    A status of D wins; an index code of A makes added; any other status, and untracked files, only count where nothing
    is known yet; of the diff, D is deleted, A and C added, the rest changed, the last line of a path counting. What is
    deleted but present is changed.
    """
    source, code = F.col("source"), F.col("code")
    word = (
        F.when((source == "status") & (code == "D"), F.struct(F.lit(4).alias("p"), F.lit("deleted").alias("s")))
        .when((source == "status") & (code == "A"), F.struct(F.lit(3).alias("p"), F.lit("added").alias("s")))
        .when(source == "diff", F.struct(F.lit(2).alias("p"), F.when(code == "D", "deleted").when(code.isin("A", "C"), "added").otherwise("changed").alias("s")))
        .when((source == "status") & (code != "?"), F.struct(F.lit(1).alias("p"), F.lit("changed").alias("s")))
        .when(source == "untracked", F.struct(F.lit(0).alias("p"), F.lit("added").alias("s")))
    )
    ranked = reports.withColumn("w", word).where("w IS NOT NULL")
    best = Window.partitionBy("path").orderBy(F.desc("w.p"), F.desc("line"))
    first = ranked.withColumn("r", F.row_number().over(best)).where("r = 1")
    return first.select("path", F.when((F.col("w.s") == "deleted") & F.col("present"), "changed").otherwise(F.col("w.s")).alias("status"))


def git_reports(spark: SparkSession, root: str, base_branch: str = BASE_BRANCH) -> DataFrame:
    """Reports for merge_changes from git in the worktree; a rename reports its new path, and D for its old one."""

    def git(*args: str) -> str | None:
        r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
        return r.stdout if r.returncode == 0 else None

    base = (git("merge-base", "HEAD", base_branch) or EMPTY_TREE).strip()
    rows = []
    for line in (git("diff", "--name-status", "-z", base, "HEAD") or "").removesuffix("\0").split("\0") if git("rev-parse", "HEAD") else []:
        rows.append(line)
    out, at = [], iter(rows)
    for code in at:
        if not code:
            continue
        path = next(at, "")
        if code[0] in "RC":
            if code[0] == "R":
                out.append((path, "diff", "D"))
            path = next(at, "")
        out.append((path, "diff", code[0]))
    parts = iter((git("status", "--porcelain", "-z", "--untracked-files=all") or "").removesuffix("\0").split("\0"))
    for line in parts:
        if not line:
            continue
        index, working, path = line[0], line[1], line[3:]
        if index in "RC":
            old = next(parts, "")
            if index == "R":
                out.append((old, "status", "D"))
        if index == "?":
            out.append((path, "untracked", "?"))
        else:
            out.append((path, "status", "D" if "D" in (index, working) else "A" if index == "A" else "M"))
    data = [(p.replace("\\", "/"), s, c, os.path.lexists(os.path.join(root, p)), i) for i, (p, s, c) in enumerate(out)]
    return spark.createDataFrame(data, "path string, source string, code string, present boolean, line int")
