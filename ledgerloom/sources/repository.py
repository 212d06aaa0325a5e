"""Repositories as a source: a safe, deterministic walk; git facts; and a Spark data source over it."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.canonical import sha256
from ledgerloom.functions.text import detect_language

# Folders that a walk leaves out.
IGNORED = (".git", ".ledgerloom", "node_modules", "dist", "build", "coverage", ".next", "out", "vendor", "__pycache__", ".venv", "venv")


@dataclass
class Scan:
    files: list[tuple[str, str]] = field(default_factory=list)  # path, language
    errors: list[tuple[str, str]] = field(default_factory=list)  # path, message


def scan_repository(root: str | Path, ignored: tuple[str, ...] = IGNORED) -> Scan:
    """Source files below root, by name; links and names with a backslash are errors and are not followed."""
    found = Scan()

    def walk(folder: Path, prefix: str) -> None:
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = prefix + entry.name
            if entry.name in ignored:
                continue
            if entry.is_symlink():
                found.errors.append((path, "a link is not followed"))
            elif "\\" in entry.name:
                found.errors.append((path, "a backslash in a name"))
            elif entry.is_dir(follow_symlinks=False):
                walk(Path(entry.path), f"{path}/")
            elif entry.is_file(follow_symlinks=False) and (language := detect_language(path)):
                found.files.append((path, language))

    walk(Path(root), "")
    return found


def read_file(root: str | Path, path: str) -> bytes:
    """The bytes of a regular file below root that did not change while it was read."""
    base = Path(root).resolve()
    target = base / path
    if not target.resolve().is_relative_to(base):
        raise ValueError(f"{path} leaves the repository")
    fd = os.open(target, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(fd, "rb") as f:
        before = os.fstat(f.fileno())
        if not stat.S_ISREG(before.st_mode):
            raise ValueError(f"{path} is no regular file")
        data = f.read()
        after = os.fstat(f.fileno())
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or len(data) != after.st_size:
        raise ValueError(f"{path} changed while it was read")
    return data


def git_facts(root: str | Path) -> dict[str, object] | None:
    """Commit, branch (None if detached) and whether anything is changed; None outside git."""

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, check=True, timeout=20).stdout.strip()

    try:
        branch = git("rev-parse", "--abbrev-ref", "HEAD")
        return {"commit_sha": git("rev-parse", "HEAD"), "branch": None if branch == "HEAD" else branch, "is_dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return None


class _File(InputPartition):
    def __init__(self, path: str, language: str) -> None:
        self.path, self.language = path, language


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        scan = scan_repository(self.root)
        if scan.errors:
            raise ValueError(f"the repository has {len(scan.errors)} entries that are not safe: {scan.errors[0]}")
        return [_File(*f) for f in scan.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data = read_file(self.root, partition.path)
        yield partition.path, partition.language, sha256(data), len(data), data


class RepositorySource(DataSource):
    """spark.dataSource.register(RepositorySource); spark.read.format("repository").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, language string, content_hash string, byte_length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
