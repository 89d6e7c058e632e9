"""File trees as a Spark data source (``filetree``), and hashing of the files that it finds.

Options: ``path`` (the root), ``excludes`` (globs, one a line), ``follow_symlinks``, ``cross_mounts``, ``respect_gitignore``
(true by default). Regular files only, hidden ones too; links aren't followed, other file systems not entered. Partitions are
sub-trees, from the root down until there are ``TREES`` of them. Ignore rules come from ``.gitignore``, ``.ignore`` and
``.git/info/exclude``, of the folders above the root too, up to the repository that it lies in. A file or folder that can't be read is a row with an error, and never stops the walk.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import stat
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyhold.errors import ScanError
from tallyhold.schemas import WALK


def _true(options, name: str, default: str) -> bool:
    return str(options.get(name, default)).lower() == "true"


class Rules:
    """Ignore rules of one folder: lines of globs, the last that matches counts, ``!`` takes back."""

    def __init__(self, base: str, lines: list[str]):
        self.base = base
        self.rules = []
        for line in lines:
            text = line.rstrip("\n").rstrip()
            if not text or text.startswith("#"):
                continue
            back = text.startswith("!")
            text = text[back:]
            only_dirs, text = text.endswith("/"), text.rstrip("/")
            anchored = "/" in text
            self.rules.append((back, only_dirs, anchored, text.lstrip("/")))

    def ignores(self, path: str, is_dir: bool) -> bool | None:
        rel = os.path.relpath(path, self.base)
        found = None
        for back, only_dirs, anchored, glob in self.rules:
            if only_dirs and not is_dir:
                continue
            if PurePosixPath(rel).full_match(glob) if anchored else fnmatch.fnmatchcase(os.path.basename(path), glob):
                found = not back
        return found


#: Sub-trees that a walk is split into, about.
TREES = 64


class Tree(InputPartition):
    """A folder to walk, with all below it or without."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.excludes = [x for x in str(options.get("excludes", "")).split("\n") if x]
        self.follow, self.cross = _true(options, "follow_symlinks", "false"), _true(options, "cross_mounts", "false")
        self.ignore = _true(options, "respect_gitignore", "true")

    def partitions(self):
        try:
            os.scandir(self.root).close()
            device = os.stat(self.root).st_dev
        except OSError as e:
            raise ScanError(f"{self.root}: {e}") from e
        flat, whole = [], [self.root]
        # breadth first: a folder is taken by itself, and each one in it becomes a tree
        while whole and len(whole) < TREES:
            below = []
            for folder in whole:
                flat.append(folder)
                below += self._folders(folder, device)
            whole = below
        return [*(Tree(x, False) for x in flat), *(Tree(x, True) for x in whole)]

    def _folders(self, folder: str, device: int) -> list[str]:
        """The folders in this one that a walk enters; one that can't be listed is left to its own walk, which says so."""
        out, rules = [], self._above(folder) + self._rules(folder)
        try:
            for e in sorted(os.scandir(folder), key=lambda e: e.name):
                if e.is_dir(follow_symlinks=self.follow) and not self._skipped(e.path, True, rules):
                    info = e.stat(follow_symlinks=self.follow)
                    loops = self.follow and os.path.realpath(folder).startswith(os.path.realpath(e.path))
                    if (self.cross or info.st_dev == device) and not loops:
                        out.append(e.path)
        except OSError:
            pass
        return out

    def _rules(self, folder: str) -> list[Rules]:
        out = []
        for name in (".git/info/exclude", ".gitignore", ".ignore") if self.ignore else ():
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    out.append(Rules(folder, f.readlines()))
            except OSError:
                pass
        return out

    def _above(self, folder: str) -> list[Rules]:
        """Rules of the folders above this one, the outermost first: up to the root, and beyond it up to the repository."""
        chain, at = [], folder
        while at != os.path.dirname(at):
            inside = at != self.root and at.startswith(self.root.rstrip("/") + "/")
            if not inside and os.path.exists(os.path.join(at, ".git")):
                break
            at = os.path.dirname(at)
            chain.append(at)
        else:
            # no repository: nothing above the root counts
            chain = [x for x in chain if (x + "/").startswith(self.root.rstrip("/") + "/")]
        return [r for x in reversed(chain) for r in self._rules(x)]

    def _skipped(self, path: str, is_dir: bool, rules: list[Rules]) -> bool:
        rel = PurePosixPath(os.path.relpath(path, self.root))
        if any(rel.full_match(g) or rel.full_match(f"**/{g}") or (g.endswith("/**") and is_dir and rel.full_match(g[:-3])) for g in self.excludes):
            return True
        verdicts = [v for r in rules if (v := r.ignores(path, is_dir)) is not None]
        return bool(verdicts and verdicts[-1])

    def _walk(self, folder: str, rules: list[Rules], deep: bool, device: int, seen: frozenset) -> Iterator[tuple]:
        rules = [*rules, *self._rules(folder)]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield folder.rstrip("/"), None, None, None, str(e)
            return
        for e in entries:
            try:
                if e.is_symlink() and not self.follow:
                    continue
                info = e.stat(follow_symlinks=self.follow)
                is_dir = stat.S_ISDIR(info.st_mode)
                if self._skipped(e.path, is_dir, rules):
                    continue
                if is_dir:
                    if deep and (self.cross or info.st_dev == device) and info.st_ino not in seen:
                        yield from self._walk(e.path, rules, True, device, seen | {info.st_ino})
                elif stat.S_ISREG(info.st_mode):
                    yield e.path, info.st_size, info.st_mtime_ns, info.st_ino, None
            except OSError as error:
                yield e.path, None, None, None, str(error)

    def read(self, partition):
        seen = frozenset({os.stat(partition.path).st_ino} if os.path.exists(partition.path) else ())
        yield from self._walk(partition.path, self._above(partition.path), partition.deep, os.stat(self.root).st_dev, seen)


class FileTree(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return WALK

    def reader(self, schema):
        return FileTreeReader(self.options)


def walk(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path, size, mtime (ns), file_id, error of all files under the root."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(path=root, **options).load()


def hash_file(path: str, buffer: int = 1 << 16) -> str:
    with open(path, "rb") as f:
        h = hashlib.sha256()
        while block := f.read(buffer):
            h.update(block)
        return h.hexdigest()


def hashed(files: DataFrame) -> DataFrame:
    """The files with their content's hash, read in pieces; null content and an error where that fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, error = [], []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                try:
                    content.append(hash_file(path))
                    error.append(None)
                except OSError as e:
                    content.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.string()), pa.array(error, pa.string())], names=[*b.schema.names, "content", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, content string, error string")


def loaded(files: DataFrame) -> DataFrame:
    """content, data of (content, path) rows whose bytes still are that content; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                if hashlib.sha256(data).hexdigest() == content:
                    yield pa.RecordBatch.from_arrays([pa.array([content], pa.string()), pa.array([data], pa.binary())], names=["content", "data"])

    return files.select("content", "path").mapInArrow(run, "content string, data binary")
