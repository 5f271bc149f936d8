"""Files that tasks open on their own and read from a byte on, and places in sorted files found by bisection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow.fs as pafs

#: Bytes that are read at a time while a place is looked for.
PROBE = 1 << 14


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local, as in ``file:``."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether a task can open ``path``, a single file, without the engine's readers."""
    try:
        fs, inner = located(path)
        return fs.get_file_info(inner).type == pafs.FileType.File
    except (OSError, ValueError, NotImplementedError):  # a scheme that only the engine knows
        return False


class Bytes:
    """A file opened for reading at any byte. ``kept`` blocks of ``PROBE`` bytes in which places were looked for are remembered:
    searches one after another meet in the same ones."""

    def __init__(self, path: str, kept: int = 64) -> None:
        fs, inner = located(path)
        self.path, self.size, self.stream = path, fs.get_file_info(inner).size, fs.open_input_file(inner)
        self.probe = lru_cache(maxsize=kept)(self._probe)

    def __enter__(self) -> Bytes:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def at(self, start: int, n: int) -> bytes:
        return self.stream.read_at(n, start) if start < self.size else b""

    def _probe(self, block: int) -> bytes:
        return self.at(block * PROBE, PROBE)

    def _until(self, start: int, stop: bytes) -> tuple[bytes, bool]:
        """The bytes from ``start`` to before the first ``stop``, and whether there is one."""
        out = b""
        while start < self.size:
            got = self.probe(start // PROBE)[start % PROBE :]
            k = got.find(stop)
            if k >= 0:
                return out + got[:k], True
            out += got
            start += len(got)
        return out, False

    def line_end(self, start: int) -> int:
        """The byte after the line that holds byte ``start``."""
        line, ended = self._until(start, b"\n")
        return start + len(line) + ended

    def line(self, start: int) -> bytes:
        return self._until(start, b"\n")[0]

    def line_from(self, start: int, first: int) -> int:
        """Where the first line starts at byte ``start`` or later; one starts at ``first``."""
        return start if start <= first else self.line_end(start - 1)

    def keyed(self, key: Callable[[bytes], int | None], start: int, stop: int) -> tuple[int, int | None]:
        """The first line from ``start`` on that has a key, and the key; or, if none starts before ``stop``, that or later."""
        while start < stop:
            if (k := key(self.line(start))) is not None:
                return start, k
            start = self.line_end(start)
        return start, None

    def bisect(self, key: Callable[[bytes], int | None], first: int, target: int) -> int:
        """Where the first line starts, from ``first`` on, whose key is ``target`` or more; lines with a key are sorted by it.
        The search goes ahead in steps that double, so that a place near ``first`` costs little."""
        low, high, step = first, self.size, PROBE
        while low + step < high:
            start, k = self.keyed(key, self.line_from(low + step, low), high)
            if k is None or k >= target:
                high = min(start, high)
                break
            low, step = self.line_end(start), 2 * step
        while low < high:
            middle = (low + high) // 2
            start, k = self.keyed(key, self.line_from(middle, low), high)
            if k is None:
                high = middle
            elif k < target:
                low = self.line_end(start)
            else:
                high = start
        return low

    def lines(self, start: int, stop: int, step: int) -> Iterator[bytes]:
        """Whole lines from ``start`` to ``stop``, about ``step`` bytes of them at a time."""
        rest = b""
        while start < stop:
            got = self.at(start, min(step, stop - start))
            start += len(got)
            whole, end, after = (rest + got).rpartition(b"\n")
            rest = after
            if whole or end:
                yield whole + end
        if rest:
            yield rest
