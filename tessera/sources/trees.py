"""Directory trees as a Spark data source, listed and read in partitions.

The driver looks only at folders of the top levels, until there are enough to deal out; each partition lists what is below
its folder itself, and where folders are few, each is dealt out to several partitions by a hash of the paths.

Spark's own file sources hide names that begin with an underscore, so `__init__.py` would be lost. Hidden entries are
skipped; .gitignore and .ignore files are honoured, those of the folders above too (.gitignore as far up as the repository
goes), and the repository's and the user's own lists of excluded names. An .ignore file counts for more than all others, a
deeper file for more than one above it. Files that can't be read or aren't valid UTF-8 are rows of `unreadable`
and left out elsewhere (strict=true: they fail the read).
"""

from __future__ import annotations

import fnmatch
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """One line of an ignore file: its pattern over relative paths, whether it takes back, whether it is for directories only."""
    line = line.rstrip("\n")
    if not line.strip() or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:].strip()
    only_dirs, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    parts = []
    for part in line.strip("/").split("/"):
        parts.append(".*" if part == "**" else fnmatch.translate(part)[len("(?s:") : -len(")\\Z")].replace(".*", "[^/]*") if part != "**" else "")
    body = "/".join(parts).replace(".*/", "(?:.*/)?")
    return re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), back, only_dirs


@dataclass(frozen=True)
class Rules:
    """Patterns in the order of rising weight, each with the folder it holds below, and that folder's place as the file sees it."""

    git: tuple = ()
    own: tuple = ()

    def with_file(self, path: str, base: str, lead: str = "") -> Rules:
        try:
            with open(path, errors="replace") as f:
                found = tuple((base, lead, p) for p in map(_pattern, f) if p)
        except OSError:
            return self
        return Rules(self.git, self.own + found) if os.path.basename(path) == ".ignore" else Rules(self.git + found, self.own)

    def ignore(self, path: str, is_dir: bool) -> bool:
        """Whether the last pattern that matches a relative path drops it."""
        for rules in (self.own, self.git):
            for base, lead, (pattern, back, only_dirs) in reversed(rules):
                inside = path[len(base) :].lstrip("/") if path.startswith(base) else None
                if inside and (is_dir or not only_dirs) and pattern.match(lead + inside):
                    return not back
        return False


def _rules_above(root: str) -> Rules:
    """What holds at a folder by files that are not in it."""
    root = os.path.abspath(root)
    above = [root]
    while os.path.dirname(above[-1]) != above[-1]:
        above.append(os.path.dirname(above[-1]))
    top = next((k for k, folder in enumerate(above) if os.path.exists(os.path.join(folder, ".git"))), 0)
    settings = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    lead = lambda k: "".join(f"{os.path.basename(folder)}/" for folder in reversed(above[:k]))
    out = Rules().with_file(os.path.join(settings, "git", "ignore"), "", lead(top)).with_file(os.path.join(above[top], ".git", "info", "exclude"), "", lead(top))
    for k in range(len(above) - 1, 0, -1):
        for name in (".gitignore", ".ignore")[k > top :]:
            out = out.with_file(os.path.join(above[k], name), "", lead(k))
    return out


def _folder(root: str, base: str, rules: Rules) -> tuple[list[os.DirEntry], list[tuple[str, Rules]]]:
    """The files of one folder that no rule drops, in order, and the folders below it with what holds there."""
    try:
        with os.scandir(os.path.join(root, base)) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError:
        return [], []
    for e in entries:
        if e.name in (".gitignore", ".ignore"):
            rules = rules.with_file(e.path, base)
    files, below = [], []
    for e in entries:
        path = f"{base}/{e.name}" if base else e.name
        if e.name.startswith(".") or rules.ignore(path, e.is_dir(follow_symlinks=False)):
            continue
        if e.is_dir(follow_symlinks=False):
            below.append((path, rules))
        elif e.is_file():
            files.append(e)
    return files, below


@dataclass
class Part(InputPartition):
    """A folder, with all below it or its own files only; of these the k-th of n shares by a hash of the path."""

    base: str
    rules: Rules
    deep: bool
    k: int = 0
    n: int = 1


def planned(root: str, wanted: int, levels: int = 3) -> list[Part]:
    """Folders of the top levels, as many as wanted if there are; fewer folders are shared."""
    parts = [Part("", _rules_above(root), True)]
    for _ in range(levels):
        if len(parts) >= wanted or not any(p.deep for p in parts):
            break
        found = [(p, _folder(root, p.base, p.rules)[1] if p.deep else []) for p in parts]
        parts = [x for p, below in found for x in [Part(p.base, p.rules, False), *(Part(base, rules, True) for base, rules in below)]]
    shares = max(1, wanted // len(parts))
    return [Part(p.base, p.rules, p.deep, k, shares) for p in parts for k in range(shares)]


def walk(root: str, extensions: tuple[str, ...] | None = None, max_size: int | None = None, part: Part | None = None) -> Iterator[tuple[str, int]]:
    """Relative path and size of the files to index, in order; no file is opened."""
    part = part or Part("", _rules_above(root), True)
    waiting = [(part.base, part.rules)]
    while waiting:
        base, rules = waiting.pop()
        files, below = _folder(root, base, rules)
        for e in files:
            path = f"{base}/{e.name}" if base else e.name
            stem, dot, extension = e.name.rpartition(".")
            if extensions is not None and (not dot or not stem or extension not in extensions) or part.n > 1 and zlib.crc32(path.encode(errors="surrogateescape")) % part.n != part.k:
                continue
            size = e.stat().st_size
            if max_size is None or size <= max_size:
                yield path, size
        if part.deep:
            waiting += reversed(below)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        listed = options.get("extensions")
        self.extensions = tuple(listed.split(",")) if listed else None
        self.max_size = int(options["maxsize"]) if options.get("maxsize") else None
        self.strict = options.get("strict", "false").lower() == "true"
        self.opens = options.get("open", "true").lower() == "true"
        self.wanted = int(options.get("partitions", 16))

    def partitions(self) -> list[Part]:
        return planned(self.root, self.wanted)

    def read(self, partition: Part) -> Iterator[tuple]:
        for name, size in walk(self.root, self.extensions, self.max_size, partition):
            shown = name.encode(errors="surrogateescape").decode(errors="replace")  # names may be no UTF-8 either
            if not self.opens:
                yield shown, size, None, None
                continue
            try:
                with open(os.path.join(self.root, name), encoding="utf-8", newline="") as f:
                    yield shown, size, f.read(), None
            except (OSError, UnicodeDecodeError) as error:
                if self.strict:
                    raise
                yield shown, size, None, type(error).__name__


class TreeSource(DataSource):
    """Options: path, extensions (comma-separated), maxSize, strict, open (false: paths and sizes only), partitions (about as many)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size long, content string, fault string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def _tree(spark: SparkSession, root: str, **options) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("path", root)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, content."""
    return _tree(spark, root, **options).where(F.col("fault").isNull()).select("path", "content")


def list_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size; no file is opened."""
    return _tree(spark, root, open="false", **options).select("path", "size")


def unreadable(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size, fault of the files that read_tree leaves out."""
    return _tree(spark, root, **options).where(F.col("fault").isNotNull()).select("path", "size", "fault")
