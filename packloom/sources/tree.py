"""Source trees on a file system: listing with ignore rules, whole files, change sets and configuration."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from packloom.functions import globs
from packloom.operators.resolving import MARKERS, TSCONFIGS
from packloom.operators.selection import NEVER


@dataclass
class Config:
    default_minify: bool = False
    global_ignore: list[str] = field(default_factory=list)
    max_output_mb: int | None = None


def load_config(home: str | None = None) -> Config:
    """The first of the configuration files that exists; one that can't be parsed gives a warning and the defaults."""
    at = Path(home or os.path.expanduser("~"))
    for path in (at / ".config" / "packloom" / "config.toml", at / ".packloomrc"):
        if path.is_file():
            try:
                found = tomllib.loads(path.read_text())
                return Config(bool(found.get("default_minify", False)), [str(x) for x in found.get("global_ignore", [])], found.get("max_output_mb"))
            except (tomllib.TOMLDecodeError, TypeError, UnicodeDecodeError) as e:
                print(f"warning: {path}: {e}", file=sys.stderr)
                return Config()
    return Config()


def _rules(folder: str, names: tuple[str, ...]) -> list[tuple[str, bool, bool]]:
    """(regex on the path below folder, exclude, folders only) of an ignore file's lines."""
    out = []
    for name in names:
        try:
            lines = Path(folder, name).read_text().splitlines()
        except (OSError, UnicodeDecodeError):
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only, body = line.endswith("/"), line.rstrip("/")
            regex = globs.to_regex(body.lstrip("/") if "/" in body else f"**/{body}", star_crosses=False)
            if regex:
                re.compile(regex)
                out.append((regex, not keep, only))
    return out


class _Walk:
    """A walk below a root: hidden files too, links not followed, in the order of path components.

    .gitignore files hold inside a git repository, from its top on, and its .git/info/exclude before them; .ignore files
    hold anywhere, those of the folders above the root too. The last rule that matches decides, deeper ones later.
    """

    def __init__(self, root: str, ignore: list[str] | None = None):
        self.root, above = root, []
        at = os.path.abspath(root)
        while at != os.path.dirname(at):
            above.append(at)
            at = os.path.dirname(at)
        repo = next((p for p in above if os.path.isdir(os.path.join(p, ".git"))), None)
        self.names = (".gitignore", ".ignore") if repo else (".ignore",)
        self.rules = [(repo, *r) for r in _rules(repo, (".git/info/exclude",))] if repo else []
        for p in reversed(above[1:]):
            inside = repo and (p == repo or p.startswith(f"{repo}/"))
            self.rules += [(p, *r) for r in _rules(p, self.names if inside else (".ignore",))]
        self.pruned = [re.compile(r) for p in ignore or [] if (r := globs.to_regex(globs.normalize(p), star_crosses=False))]

    def listed(self, folder: str, rules: list) -> Iterator[os.DirEntry]:
        """What is left of a folder, whose own rules are among the rules."""
        for e in sorted(os.scandir(folder), key=lambda x: x.name):
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name in NEVER or not is_dir and not e.is_file(follow_symlinks=False):
                continue
            gone = False
            for base, regex, exclude, only in rules:
                if (is_dir or not only) and re.match(regex, os.path.relpath(e.path, base)):
                    gone = exclude
            below = os.path.relpath(e.path, self.root)
            if not gone and not any(p.match(below) for p in self.pruned):
                yield e

    def with_own(self, folder: str, rules: list) -> list:
        return [*rules, *[(folder, *r) for r in _rules(folder, self.names)]]

    def files(self, folder: str, rules: list) -> Iterator[tuple[str, int]]:
        rules = self.with_own(folder, rules)
        for e in self.listed(folder, rules):
            if e.is_dir(follow_symlinks=False):
                yield from self.files(e.path, rules)
            else:
                yield e.path, e.stat(follow_symlinks=False).st_size

    def tops(self) -> list[list[str]]:
        """The root's entries, in order: each folder by itself, files between two folders together."""
        if os.path.isfile(self.root):
            return [[self.root]]
        out, before = [], False
        for e in [] if set(Path(self.root).parts) & set(NEVER) else self.listed(self.root, self.with_own(self.root, self.rules)):
            is_file = not e.is_dir(follow_symlinks=False)
            if is_file and before:
                out[-1].append(e.path)
            else:
                out.append([e.path])
            before = is_file
        return out

    def below(self, tops: list[str]) -> Iterator[tuple[str, int]]:
        for path in tops:
            if os.path.isdir(path) and path != self.root:
                yield from self.files(path, self.with_own(self.root, self.rules))
            else:
                yield path, os.path.getsize(path)


def walk(root: str, ignore: list[str] | None = None) -> list[tuple[str, int]]:
    """(path, size) of the regular files below root in the order of path components. A root that is a file is that file."""
    w = _Walk(root, ignore)
    return [f for tops in w.tops() for f in w.below(tops)]


#: Files of one partition of a listing, so that seq is in order over all partitions; more of them take the next numbers.
PART_FILES = 1 << 32


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("ignore", json list).load(root): seq, path and size; hidden names included.

    One partition for each folder in the root and for the files between two of them. seq orders the files, with gaps.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "seq bigint, path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.ignore = options["path"], json.loads(options.get("ignore", "[]"))

    def partitions(self):
        return [InputPartition(x) for x in enumerate(_Walk(self.root, self.ignore).tops())] or [InputPartition((0, []))]

    def read(self, partition):
        nth, tops = partition.value
        yield from ((nth * PART_FILES + i, p, n) for i, (p, n) in enumerate(_Walk(self.root, self.ignore).below(tops)))


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("ignore", json.dumps(ignore or [])).load(root)


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """seq and path: changed tracked files, then untracked ones; a failing command gives none."""
    out = []
    for command in (["git", "diff", "--name-only", "HEAD"], ["git", "ls-files", "--others", "--exclude-standard"]):
        got = subprocess.run(command, cwd=folder, capture_output=True, text=True)
        if got.returncode == 0:
            out += got.stdout.splitlines()
    rows = [(i, p, os.path.getsize(f) if os.path.isfile(f := os.path.join(folder, p)) else 0) for i, p in enumerate(out)]
    return spark.createDataFrame(rows, "seq bigint, path string, size bigint")


def with_content(files: DataFrame, base: str = "") -> DataFrame:
    """The files' bytes; a file that can't be read is dropped. One row a file: the size filter comes before this."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, len(batch), 64):
                rows = []
                for r in batch.slice(a, 64).to_pylist():
                    try:
                        rows.append(r | {"content": Path(base, r["path"]).read_bytes()})
                    except OSError:
                        continue
                yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("content", pa.binary())))

    return files.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*files.dtypes, ("content", "binary")]))


@F.pandas_udf(StringType())
def real_file(path: pd.Series) -> pd.Series:
    """The real path of a file, or null where none is; paths have no leading slash."""
    return pd.Series([os.path.realpath(f"/{p}").lstrip("/") if os.path.isfile(f"/{p}") else None for p in path], dtype=object)


def look_up(folders: set[str], looked: set[str], marks: set[str], configs: dict[str, str]) -> None:
    """Add the markers of projects, .git folders among them, and the configs with aliases of the folders and all above them."""
    for folder in folders:
        while folder not in looked:
            looked.add(folder)
            at = f"{folder}/" if folder else ""
            marks |= {f"{at}{m}" for m in MARKERS if os.path.isfile(f"/{at}{m}")} | ({f"{at}.git"} if os.path.isdir(f"/{at}.git") else set())
            for name in TSCONFIGS:
                try:
                    configs[f"{at}{name}"] = Path(f"/{at}{name}").read_bytes().decode()
                except (OSError, UnicodeDecodeError):
                    continue
            folder = os.path.dirname(folder)
