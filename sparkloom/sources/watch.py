"""A source tree as a streaming source of add, change and unlink events.

Each poll compares the tree's files (size and modification time) with those of the poll before. What differs becomes
events, which are written under a state folder before their offset is given out, so a batch that is run again reads the
same events. A file that was written within the last moments waits for the next poll.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("root", "/repo").option("state", "/shared/state").load()
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.ids import IGNORED, glob_regex

EVENTS = "root string, ts timestamp, seq long, path string, type string"
#: Fixed value: seconds for which a file must have stayed as it is.
STABLE = 0.05


def snapshot(root: str, ignore: tuple[str, ...] = IGNORED) -> dict[str, list]:
    """{relative path: [size, modification time in ns]} of the tree's files that no glob matches."""
    patterns = [re.compile(glob_regex(g)) for g in ignore]
    skipped = lambda path: any(p.search(path) for p in patterns)
    out = {}
    for folder, names, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace("\\", "/")
        rel = "" if rel == "." else f"{rel}/"
        names[:] = [n for n in names if not skipped(f"/{rel}{n}/")]
        for f in files:
            path = f"{rel}{f}"
            try:
                s = os.stat(os.path.join(folder, f), follow_symlinks=False)
            except OSError:
                continue
            if not skipped(f"/{path}"):
                out[path] = [s.st_size, s.st_mtime_ns]
    return out


def difference(before: dict, now: dict, at_ns: int) -> tuple[list[tuple[str, str]], dict]:
    """(path, type) in order of path, and the snapshot to compare with next; files written just now are left for then."""
    events, kept = [], dict(now)
    for path in sorted(before.keys() | now.keys()):
        if path not in now:
            events.append((path, "unlink"))
        elif now[path] != before.get(path):
            if at_ns - now[path][1] < STABLE * 1e9:
                kept.pop(path)
                if path in before:
                    kept[path] = before[path]
            else:
                events.append((path, "change" if path in before else "add"))
    return events, kept


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root, self.state = options["root"], options["state"]
        self.ignore = (*IGNORED, *json.loads(options.get("ignore", "[]")))
        os.makedirs(self.state, exist_ok=True)

    def _file(self, kind: str, seq: int) -> str:
        return os.path.join(self.state, f"{kind}-{seq:012}.json")

    def _put(self, path: str, value) -> None:
        with open(f"{path}.tmp", "w") as f:
            json.dump(value, f)
        os.replace(f"{path}.tmp", path)

    def initialOffset(self) -> dict:  # noqa: N802
        # What is there at the start is no event.
        if not os.path.exists(self._file("files", 0)):
            self._put(self._file("files", 0), snapshot(self.root, self.ignore))
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seq = start["seq"]
        if not os.path.exists(self._file("events", seq + 1)):
            with open(self._file("files", seq)) as f:
                before = json.load(f)
            events, kept = difference(before, snapshot(self.root, self.ignore), time.time_ns())
            if not events:
                return iter(()), start
            self._put(self._file("files", seq + 1), kept)
            self._put(self._file("events", seq + 1), {"ts": time.time(), "events": events})
        end = {"seq": seq + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        out = []
        for seq in range(start["seq"] + 1, end["seq"] + 1):
            with open(self._file("events", seq)) as f:
                got = json.load(f)
            ts = dt.datetime.fromtimestamp(got["ts"], dt.UTC)
            out += [(self.root, ts, seq * 1_000_000 + i, path, kind) for i, (path, kind) in enumerate(got["events"])]
        return iter(out)

    def commit(self, end: dict) -> None:
        for kind in ("files", "events"):
            old = self._file(kind, end["seq"] - 1)
            if os.path.exists(old):
                os.remove(old)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Reader(self.options)
