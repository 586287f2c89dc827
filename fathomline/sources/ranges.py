"""Files read by byte ranges in tasks, through any file system that Arrow opens (local and shared folders, object stores)."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes that one request to the file system asks for at least.
REQUEST = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder, by path; names that begin with a dot or an underscore are left out. A missing path has none."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if info.type == fs.FileType.Directory else []
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")) and (not suffixes or x.path.lower().endswith(suffixes)))


@dataclass
class Span(InputPartition):
    """Bytes ``start`` to ``end`` of a file of ``size`` bytes."""

    path: str
    start: int
    end: int
    size: int

    def __post_init__(self) -> None:
        InputPartition.__init__(self, (self.path, self.start, self.end))


def spans(path: str, start: int, end: int, size: int, most: int) -> list[Span]:
    return [Span(path, a, min(a + most, end), size) for a in range(start, end, most)]


class Bytes:
    """Random access to a file; holds the part last asked for."""

    def __init__(self, root: str, path: str) -> None:
        self.file = opened(root)[0].open_input_file(path)
        self.size = self.file.size()
        self.base, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """At most ``n`` bytes from ``place`` on; fewer at the end of the file."""
        if place < self.base or place + n > self.base + len(self.held):
            self.base, self.held = place, self.file.read_at(max(0, min(max(n, REQUEST), self.size - place)), place)
        return self.held[place - self.base : place - self.base + n]

    def find(self, what: bytes, place: int, end: int) -> int:
        """Where ``what`` next begins, from ``place`` on and before ``end``; -1 if nowhere."""
        while place < end:
            part = self.at(place, min(REQUEST, end - place) + len(what) - 1)
            k = part.find(what)
            if 0 <= k < end - place:
                return place + k
            place += max(len(part) - len(what) + 1, 1)
        return -1

    def close(self) -> None:
        self.file.close()

