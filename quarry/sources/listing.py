"""Spark data sources over a repository: its files, listed before they are read, and its git log.

``quarry_tree`` lists directories and leaves excluded ones out before it goes into them; only files
that pass the exclusion and the filters that Spark pushes down are opened. The driver lists as many
levels as give each task some directories, no more; tasks list and read what lies below. A file or
directory that can't be read, and one too large for a cell, is a row with a status and its size.

``quarry_git_log`` deals the commits of a log over tasks, each of which asks git for its own.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

#: Files of this size and more are rows without content: a cell can't hold them.
MOST_BYTES = 1 << 30
#: Directories that the driver hands out at least, where the tree has so many; bytes of a task that reads listed files; of a batch.
SPLITS, TASK_BYTES, BATCH_BYTES = 256, 64 << 20, 8 << 20

TREE = "file string, size long, mtime timestamp, status string, content string"
LOG = "commit string, author string, ts timestamp, added long, removed long, file string"


@dataclass(frozen=True)
class Entry:
    path: str
    is_dir: bool
    size: int = 0
    mtime: float = 0.0


class _Local:
    """The machine's own file system. Links to directories are not followed, which could go round for ever."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, path: str) -> Iterator[Entry]:
        with os.scandir(os.path.join(self.root, path)) as found:
            for e in found:
                inner = f"{path}/{e.name}" if path else e.name
                if e.is_dir(follow_symlinks=False):
                    yield Entry(inner, True)
                elif not e.is_dir():
                    try:
                        about = e.stat()
                    except OSError:
                        about = e.stat(follow_symlinks=False)
                    yield Entry(inner, False, about.st_size, about.st_mtime)

    def read(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()


class _Remote:
    """What Arrow's file systems reach."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def entries(self, path: str) -> Iterator[Entry]:
        base = f"{self.root.rstrip('/')}/{path}".rstrip("/")
        for e in self.fs.get_file_info(pafs.FileSelector(base)):
            inner = f"{path}/{e.base_name}" if path else e.base_name
            yield Entry(inner, e.type == pafs.FileType.Directory, e.size or 0, e.mtime.timestamp() if e.mtime else 0.0)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root.rstrip('/')}/{path}") as f:
            return f.read()


def known(root: str) -> bool:
    """Whether ``quarry_tree`` reaches this path; others are Spark's own readers' affair."""
    return re.match(r"(?:[a-z0-9+]+):", root) is None or root.startswith(("file:", "s3:", "gs:", "abfs:", "abfss:"))


def _store(root: str) -> _Local | _Remote:
    if re.match(r"[a-z0-9+]+:", root) is None:
        return _Local(root)
    return _Local(re.sub(r"^file:/+", "/", root)) if root.startswith("file:") else _Remote(root)


@dataclass(frozen=True)
class Rules:
    """What is listed: exclusions by directory name and by pattern, submodules, and the filters pushed down."""

    dirs: frozenset[str]
    patterns: tuple[str, ...]
    modules: frozenset[str] = frozenset()
    filters: tuple[Filter, ...] = ()

    def enters(self, path: str) -> bool:
        name = path.rpartition("/")[2]
        if name in self.dirs or path in self.modules or any(re.search(p, path + "/") for p in self.patterns):
            return False
        return all(self._may_hold(path + "/", f) for f in self.filters)

    @staticmethod
    def _may_hold(folder: str, f: Filter) -> bool:
        if f.attribute != ("file",):
            return True
        starts = [f.value] if isinstance(f, (StringStartsWith, EqualTo)) else list(f.value) if isinstance(f, In) else None
        if starts is None:
            return True
        whole = not isinstance(f, StringStartsWith)
        return any(s.startswith(folder) or not whole and folder.startswith(s) for s in starts if s is not None)

    def takes(self, e: Entry) -> bool:
        if any(re.search(p, e.path) for p in self.patterns):
            return False
        return all(_holds(f, e.path if f.attribute == ("file",) else e.size) for f in self.filters)


def _holds(f: Filter, value) -> bool:
    tests = {
        EqualTo: lambda: value == f.value, In: lambda: value in f.value, StringStartsWith: lambda: value.startswith(f.value), StringEndsWith: lambda: value.endswith(f.value),
        StringContains: lambda: f.value in value, GreaterThan: lambda: value > f.value, GreaterThanOrEqual: lambda: value >= f.value, LessThan: lambda: value < f.value, LessThanOrEqual: lambda: value <= f.value,
    }
    return tests[type(f)]()


_TEXT_FILTERS = (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)
_SIZE_FILTERS = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class TreePartition(InputPartition):
    def __init__(self, rules: Rules, folders: tuple[str, ...], files: tuple[Entry, ...], failed: tuple[tuple[str, str], ...] = ()):
        super().__init__((rules, folders, files, failed))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        split = lambda key: [x for x in options.get(key, "").split("\n") if x]
        self.rules = Rules(frozenset(split("dirs")), tuple(split("patterns")))
        self.content = options.get("content", "true") == "true"
        self.most = int(options.get("mostbytes", MOST_BYTES))
        self.splits = int(options.get("splits", SPLITS))
        self.modules = options.get("submodules", "false") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        mine = []
        for f in filters:
            kinds = {("file",): _TEXT_FILTERS, ("size",): _SIZE_FILTERS}.get(getattr(f, "attribute", None), ())
            if isinstance(f, kinds) and f.value is not None:
                mine.append(f)
            else:
                yield f
        self.rules = Rules(self.rules.dirs, self.rules.patterns, self.rules.modules, tuple(mine))

    def partitions(self) -> list[InputPartition]:
        store = _store(self.root)
        if self.modules:
            try:
                said = store.read(".gitmodules").decode("utf-8", "replace")
            except OSError:
                said = ""
            paths = frozenset(m.strip().rstrip("/") for m in re.findall(r"(?m)^\s*path\s*=\s*(.+?)\s*$", said))
            self.rules = Rules(self.rules.dirs, self.rules.patterns, paths, self.rules.filters)
        folders, files, failed = [""], [], []
        while folders and len(folders) < self.splits:
            below = []
            for folder in folders:
                found, why = self._listed(store, folder)
                failed += why
                below += [e.path for e in found if e.is_dir]
                files += [e for e in found if not e.is_dir]
            folders = below
        out, held, size = [TreePartition(self.rules, (f,), ()) for f in folders], [], 0
        for e in files:
            held.append(e)
            size += min(e.size, self.most) + 4096
            if size >= TASK_BYTES:
                out.append(TreePartition(self.rules, (), tuple(held)))
                held, size = [], 0
        if held or failed or not out:
            out.append(TreePartition(self.rules, (), tuple(held), tuple(failed)))
        return out

    def _listed(self, store: _Local | _Remote, folder: str) -> tuple[list[Entry], list[tuple[str, str]]]:
        try:
            return [e for e in store.entries(folder) if (self.rules.enters(e.path) if e.is_dir else self.rules.takes(e))], []
        except OSError as why:
            return [], [(folder, f"unlisted: {type(why).__name__}")]

    def _walk(self, store: _Local | _Remote, folders: Iterable[str]) -> Iterator[tuple[Entry, str]]:
        todo = list(folders)
        while todo:
            found, failed = self._listed(store, todo.pop())
            yield from ((Entry(path, True), why) for path, why in failed)
            for e in found:
                if e.is_dir:
                    todo.append(e.path)
                else:
                    yield e, ""

    def read(self, partition: TreePartition) -> Iterator[pa.RecordBatch]:
        store = _store(self.root)
        self.rules, folders, files, failed = partition.value
        columns: list[list] = [[] for _ in range(5)]
        size = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in TREE.split(", ")])

        def entries() -> Iterator[tuple[Entry, str]]:
            yield from ((Entry(path, True), why) for path, why in failed)
            yield from ((e, "") for e in files)
            yield from self._walk(store, folders)

        for e, status in entries():
            text = None
            if not status and e.size >= self.most:
                status = "too large"
            elif not status and self.content:
                try:
                    text = store.read(e.path).decode("utf-8", "replace")
                except OSError as why:
                    status = f"unreadable: {type(why).__name__}"
            row = (e.path, e.size, datetime.fromtimestamp(e.mtime, timezone.utc), status or "read", text)
            for c, v in zip(columns, row, strict=True):
                c.append(v)
            size += len(text or "") + 200
            if size >= BATCH_BYTES:
                yield batch()
                columns, size = [[] for _ in range(5)], 0
        if columns[0]:
            yield batch()


class Tree(DataSource):
    """Options: path, dirs and patterns (left out; one a line), submodules, content, mostbytes, splits."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class LogPartition(InputPartition):
    def __init__(self, limits: tuple[str, ...], skip: int, count: int):
        super().__init__((limits, skip, count))


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = re.sub(r"^file:/+", "/", options["path"])
        self.each = int(options.get("commits", 5000))
        self.limits: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            # Git's bounds are of the commit's date to the second; the filter itself stays and is exact.
            if f.__class__ in (GreaterThan, GreaterThanOrEqual) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                self.limits.append(f"--since-as-filter={int(f.value.timestamp()) - 1}")
            yield f

    def _git(self, *words: str) -> subprocess.Popen:
        return subprocess.Popen(["git", "-c", "safe.directory=*", "-C", self.path, *words], stdout=subprocess.PIPE, stderr=subprocess.PIPE)

    def partitions(self) -> list[InputPartition]:
        out, err = self._git("rev-list", "--count", *self.limits, "HEAD").communicate()
        if not out.strip():
            raise ValueError(f"no git log in {self.path}: {err.decode(errors='replace').strip()}")
        total = int(out)
        return [LogPartition(tuple(self.limits), k, self.each) for k in range(0, max(total, 1), self.each)]

    def read(self, partition: LogPartition) -> Iterator[tuple]:
        limits, skip, count = partition.value
        run = self._git("log", *limits, f"--skip={skip}", f"--max-count={count}", "--numstat", "--format=%x1e%H%x1f%an%x1f%cI", "HEAD")
        commit = author = ts = None
        for raw in run.stdout:
            line = raw.decode("utf-8", "replace").rstrip("\n")
            if line.startswith("\x1e"):
                commit, author, when = line[1:].split("\x1f")
                ts = datetime.fromisoformat(when).astimezone(timezone.utc)
            elif line and (m := re.match(r"(\d+|-)\t(\d+|-)\t(.*)", line)):
                yield commit, author, ts, *(int(v) if v != "-" else None for v in m.groups()[:2]), m[3]
        if run.wait():
            raise OSError(f"git log: {run.stderr.read().decode(errors='replace').strip()}")


class GitLog(DataSource):
    """Options: path of a working copy, commits of a task."""

    @classmethod
    def name(cls) -> str:
        return "quarry_git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)
