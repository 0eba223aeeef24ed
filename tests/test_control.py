import os
import subprocess

import pytest
from sparkloom.sources import control as C


def test_confinement(tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    assert C.confine_path(str(root / "in"), str(root)) == str(root / "in")
    assert C.confine_path(str(root / "in/new/file"), str(root)) == str(root / "in")
    (root / "leak").symlink_to(tmp_path / "out")
    (root / "gone").symlink_to(tmp_path / "nowhere")
    for bad in (root / "leak", tmp_path / "out", f"{root}/a..b", f"{root}/../out"):
        with pytest.raises(C.ConfinementError):
            C.confine_path(str(bad), str(root))
    assert C.confine_path(f"{root}/in/../in", str(root)) == str(root / "in")  # nothing is left of it after normalising
    assert C.confine_root(str(root / "in"), [str(root)]) == str(root / "in")
    for bad in (tmp_path / "out", tmp_path / "nothing"):
        with pytest.raises(C.ConfinementError):
            C.confine_root(str(bad), [str(root)])
    assert C.is_within("/a/b/", "/a") and not C.is_within("/ab", "/a")


def test_registry_and_sessions(tmp_path):
    repo = tmp_path / "repo"
    (repo / "w1").mkdir(parents=True)
    (repo / "link").symlink_to(repo / "w1")
    (repo / "leak").symlink_to(tmp_path)
    r, s = C.Registry(str(repo)), C.Sessions()
    a = r.register("w1")
    assert (a.id, a.base_branch) == ("wt-1", "develop")
    assert r.register(str(repo / "link"), "main") is a and a.base_branch == "main"
    for bad, error in (("../x", C.ConfinementError), ("leak", C.ConfinementError), ("none", FileNotFoundError), ("", ValueError)):
        with pytest.raises(error):
            r.register(bad)
    assert r.confine("wt-1", "x/y") == str(repo / "w1/x/y")
    with pytest.raises(C.ConfinementError):
        r.confine("wt-1", "../w2")
    with pytest.raises(KeyError):
        r.confine("wt-7", "x")
    out = C.register_worktree(r, s, "w1")
    assert out["worktree_id"] == "wt-1" and s.get(str(repo / "w1")) == "wt-1"
    assert C.register_worktree(r, s, "none")["error"] == "FileNotFoundError"
    s.bind("k", "wt-1")
    s.unbind("k")
    assert s.get("k") is None and len(s.all()) == 1
    r.remove("wt-1")
    assert r.get("wt-1") is None and r.all() == []


def test_lifecycle():
    class Clock:
        waiting: list = []

        def __init__(self, seconds, call):
            self.call, self.on = call, False

        def start(self):
            self.on = True
            Clock.waiting.append(self)

        def cancel(self):
            self.on = False

    gone = []
    life = C.Lifecycle(gone.append, 10, Clock)
    life.touch("a")
    life.touch("a")
    life.touch("b")
    life.cancel("b")
    for t in list(Clock.waiting):
        if t.on:
            t.call()
    assert gone == ["a"]
    life.touch("c")
    life.evict("c")
    life.touch("d")
    life.close()
    assert gone == ["a", "c"] and not any(t.on for t in Clock.waiting)


def test_merge_changes(spark):
    rows = [
        ("m", "diff", "M", True, 1), ("m", "status", "A", True, 2), ("d", "diff", "A", False, 3), ("d", "status", "D", False, 4), ("back", "status", "D", True, 5), ("u", "untracked", "?", True, 6),
        ("known", "diff", "D", False, 7), ("known", "status", "M", False, 8), ("c", "diff", "C", True, 9), ("t", "status", "M", True, 10), ("q", "status", "?", True, 11),
    ]
    df = spark.createDataFrame(rows, "path string, source string, code string, present boolean, line int")
    assert {r.path: r.status for r in C.merge_changes(df).collect()} == {"m": "added", "d": "deleted", "back": "changed", "u": "added", "known": "deleted", "c": "added", "t": "changed"}


def test_git(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)

    def put(name, text="x\n" * 30):
        (tmp_path / name).write_text(text)

    git("init", "-q", "-b", "develop")
    for n in ("keep", "edit", "drop", "old"):
        put(n, f"{n}\n" * 30)
    git("add", "-A")
    git("commit", "-qm", "1")
    git("checkout", "-qb", "work")
    put("edit", "new\n")
    put("made")
    git("mv", "old", "renamed")
    git("add", "-A")
    git("commit", "-qm", "2")
    os.remove(tmp_path / "drop")
    put("staged")
    git("add", "staged")
    put("loose")
    got = {r.path: r.status for r in C.merge_changes(C.git_reports(spark, str(tmp_path))).collect()}
    assert got == {"edit": "changed", "made": "added", "renamed": "changed", "old": "deleted", "drop": "deleted", "staged": "added", "loose": "added"}
