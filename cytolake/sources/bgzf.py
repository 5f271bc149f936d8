"""Block gzip, read by many tasks: BAM records, and lines of text.

Such a file is a row of gzip members that say how long they are. A task takes a stretch of the file's bytes, finds the
first block that starts there, and reads on to the end of what began before the stretch's end. A line belongs to the
stretch in whose blocks it starts, and so does a record. Lines are found by their ends. Where records start is not marked:
a place counts if a long chain of sound records follows from it. Each task also looks up the first record of the next
stretch in this way and must arrive at it record by record, so a wrong guess is an error and never a wrong result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import Bytes

RECORDS = "qname string, flag int, contig string, start int, cigar string, xm string, xg string"
#: Compressed bytes of a task's stretch.
STRETCH = 32 << 20
#: Records in a row that make a guess of a start, bytes of the largest record that a guess may rest on, and rows of a batch.
CHAIN, LARGEST, ROWS = 64, 1 << 26, 10_000

#: Fixed values of the formats: what a block starts with, the letters of operations in the order of their codes, and
#: sizes of the types of tags.
BLOCK = b"\x1f\x8b\x08\x04"
_OPS, _SIZES = "MIDNSHP=X", {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FIXED = struct.Struct("<iiBBHHHiii")  # contig, place, name, quality, bin, operations, flag, bases, contig and place of the mate
_MOST = 1 << 16


def block_size(head: bytes) -> int | None:
    """Bytes of the block that starts with ``head``; None if none does."""
    if len(head) < 18 or not head.startswith(BLOCK):
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def is_blocked(path: str) -> bool:
    with Bytes(path) as f:
        return block_size(f.at(0, 64)) is not None


def _inflated(raw: bytes) -> bytes | None:
    """The content of a whole block; None if it is broken."""
    start = 12 + struct.unpack_from("<H", raw, 10)[0]
    try:
        out = zlib.decompress(raw[start:-8], -15)
    except zlib.error:
        return None
    return out if (zlib.crc32(out), len(out)) == struct.unpack("<II", raw[-8:]) else None


def blocks(f: Bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, content) of the blocks from byte ``at``, where one starts, to the end of the file."""
    held, base = b"", at
    while True:
        here = at - base
        if len(held) - here < 2 * _MOST and base + len(held) < f.size:
            held = held[here:] + f.at(base + len(held), 1 << 20)
            base, here = at, 0
        if here >= len(held):
            return
        n = block_size(held[here : here + 4096])
        content = _inflated(held[here : here + n]) if n and here + n <= len(held) else None
        if content is None:
            raise ValueError(f"{f.path} is broken at byte {at}")
        yield at, content
        at += n


def first_block(f: Bytes, at: int) -> int:
    """Where the first block starts from byte ``at`` on; the file's size if none does."""
    while at < f.size:
        held, k = f.at(at, 4 * _MOST), -1
        while (k := held.find(BLOCK, k + 1)) >= 0:
            n = block_size(held[k : k + 4096])
            whole = held[k : k + n] if n and k + n <= len(held) else f.at(at + k, n) if n else b""
            if n and len(whole) == n and _inflated(whole) is not None:
                return at + k
        at += max(len(held) - len(BLOCK) + 1, 1)
    return f.size


# --- lines --------------------------------------------------------------------


def _own_lines(f: Bytes, low: int, high: int) -> Iterator[bytes]:
    """Whole lines, without the last one's end, that start in the blocks that start from byte ``low`` to before ``high``."""
    rest, skipping = b"", low > 0
    for at, content in blocks(f, first_block(f, low)):
        if at >= high:
            k = content.find(b"\n")
            if skipping or k < 0:
                if skipping:
                    return
                rest += content
                continue
            yield rest + content[:k]
            return
        if skipping:  # what goes on from the block before is that block's line
            k = content.find(b"\n")
            if k < 0:
                continue
            content, skipping = content[k + 1 :], False
        text = rest + content
        whole, end, rest = text.rpartition(b"\n")
        if end:
            yield whole
    if rest:
        yield rest


def _line_rows(chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks:
        made = [x.rstrip(b"\r").decode() for x in chunk.split(b"\n")]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])


# --- records ------------------------------------------------------------------


class Contents:
    """The contents of blocks as one stream, with the block of each byte at hand."""

    def __init__(self, f: Bytes, at: int) -> None:
        self.blocks, self.held, self.at = blocks(f, at), b"", 0
        self.starts: list[tuple[int, int]] = []  # (place in ``held``, first byte of the block)

    def more(self) -> bool:
        got = next(self.blocks, None)
        if got is None:
            return False
        if self.at > 1 << 18:
            last = max((i for i, (p, _) in enumerate(self.starts) if p <= self.at), default=0)
            self.starts = [(p - self.at, b) for p, b in self.starts[last:]]
            self.held, self.at = self.held[self.at :], 0
        self.starts.append((len(self.held), got[0]))
        self.held += got[1]
        return True

    def need(self, n: int) -> bool:
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def block(self) -> tuple[int, int]:
        """(first byte of its block, place in the block) of the byte that comes next, which must be there."""
        while len(self.starts) > 1 and self.starts[1][0] <= self.at:
            self.starts.pop(0)
        return self.starts[0][1], self.at - self.starts[0][0]

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise EOFError
        self.at += n
        return self.held[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def read_header(s) -> list[tuple[str, int]]:
    """Contigs and their lengths; ``s`` takes bytes, and is left at the first record."""
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.take(s.int())
    out = []
    for _ in range(s.int()):
        name = s.take(s.int())[:-1].decode()
        out.append((name, s.int()))
    return out


def _sound(raw: bytes, at: int, lengths: list[int]) -> int | None:
    """Bytes of the record at ``at``, its size included, if it can be one as far as it is there; else None."""
    if len(raw) - at < 4 + _FIXED.size:
        return None
    size = struct.unpack_from("<i", raw, at)[0]
    ref, pos, name, _, _, ops, _, bases, mate, mate_pos = _FIXED.unpack_from(raw, at + 4)
    place = lambda r, p: -1 <= r < len(lengths) and -1 <= p and (r < 0 or p < max(lengths[r], 1))
    if not (name >= 1 and bases >= 0 and place(ref, pos) and place(mate, mate_pos) and LARGEST >= size >= _FIXED.size + name + 4 * ops + (bases + 1) // 2 + bases):
        return None
    text = raw[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] or not all(33 <= c <= 126 for c in text[:-1])):
        return None
    codes = raw[at + 36 + name : at + 36 + name + 4 * ops : 4]
    return None if any(c & 15 > 8 for c in codes) else 4 + size


def _chained(s: Contents, at: int, lengths: list[int]) -> bool:
    """Whether sound records follow each other from ``at`` on, ``CHAIN`` of them or all to the end of the file."""
    for _ in range(CHAIN):
        while len(s.held) - at < 4 + _FIXED.size + 256:
            if not s.more():
                break
        if at == len(s.held):
            return True
        n = _sound(s.held, at, lengths)
        if n is None:
            return False
        while len(s.held) < at + n:
            if not s.more():
                return False
        at += n
    return True


def first_record(f: Bytes, at: int, lengths: list[int]) -> tuple[int, int] | None:
    """(first byte of the block, place in it) of the first record that starts in a block from byte ``at`` on."""
    s = Contents(f, first_block(f, at))
    k = 0
    while True:
        while len(s.held) - k < 4 + _FIXED.size:
            if not s.more():
                return None
        if _sound(s.held, k, lengths) is not None and _chained(s, k, lengths):
            s.at = k
            return s.block()
        k += 1


def _tags(raw: bytes, at: int) -> tuple[str | None, str | None]:
    """The tags XM and XG among those that start at ``at``."""
    found = {}
    while at < len(raw):
        name, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            if name in (b"XM", b"XG"):
                found[name] = raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            at += _SIZES[kind]
    return found.get(b"XM"), found.get(b"XG")


@lru_cache(maxsize=10_000)
def _cigar(ops: bytes) -> str:
    return "".join(f"{x >> 4}{_OPS[x & 15]}" for (x,) in struct.iter_unpack("<I", ops)) or "*"


def decoded(raw: bytes, contigs: list[str]) -> tuple:
    """A row of ``RECORDS`` from a record without its size."""
    ref, pos, name, _, _, ops, flag, bases, _, _ = _FIXED.unpack_from(raw)
    at = 32 + name + 4 * ops
    return (raw[32 : 32 + name - 1].decode(), flag, contigs[ref] if ref >= 0 else "*", pos + 1, _cigar(raw[32 + name : at]), *_tags(raw, at + (bases + 1) // 2 + bases))


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [k.split()[0] for k in RECORDS.split(", ")])


def _records(f: Bytes, low: int, high: int) -> Iterator[tuple[bytes, list[str]]]:
    """(record, contigs) of the records that start in the blocks from byte ``low`` to before ``high``."""
    s = Contents(f, 0)
    contigs = read_header(s)
    names, lengths = [c for c, _ in contigs], [n for _, n in contigs]
    if low > 0:
        start = first_record(f, low, lengths)
        if s.need(1) and s.block()[0] >= low:  # the header ends in this stretch or after it
            start = s.block()
        if start is None or start[0] >= high:
            return
        s = Contents(f, start[0])
        s.take(start[1])
    end = first_record(f, high, lengths) if high < f.size else None
    if high < f.size:
        head = Contents(f, 0)
        read_header(head)
        if head.need(1) and head.block()[0] >= high:
            end = head.block()
    try:
        while s.need(1):
            here = s.block()
            if here[0] >= high:
                if here != end:
                    raise ValueError(f"records of {f.path} do not meet at byte {high}; read it in one stretch")
                return
            yield s.take(s.int()), names
    except EOFError:
        raise ValueError(f"{f.path} ends inside a record") from None
    if end is not None:
        raise ValueError(f"records of {f.path} do not meet at byte {high}; read it in one stretch")


# --- data sources -------------------------------------------------------------


class Stretch(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.stretch = options["path"], int(options.get("stretch", STRETCH))
        self.summary = options.get("summary", "false") == "true"

    def partitions(self) -> list[Stretch]:
        with Bytes(self.path) as f:
            return [Stretch(a, min(a + self.stretch, f.size)) for a in range(0, max(f.size, 1), self.stretch)]


class BamReader(_Reader):
    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with Bytes(self.path) as f:
            if self.summary:
                n = pairs = 0
                for raw, _ in _records(f, partition.low, partition.high):
                    n += 1
                    pairs += _FIXED.unpack_from(raw)[6] & 0xD == 1  # paired, and neither it nor its mate unmapped
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pairs], pa.int64())], ["n", "pairs"])
                return
            rows = []
            for raw, contigs in _records(f, partition.low, partition.high):
                rows.append(decoded(raw, contigs))
                if len(rows) == ROWS:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows)


class LineReader(_Reader):
    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with Bytes(self.path) as f:
            yield from _line_rows(_own_lines(f, partition.low, partition.high))


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: the records of a BAM file in their order along the partitions. Options:
    ``stretch``, compressed bytes of a task; ``summary``, for one row a task with its records and those with a mate."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "n long, pairs long" if self.options.get("summary", "false") == "true" else RECORDS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


class LineSource(DataSource):
    """``spark.read.format("bgzf_lines").load(path)``: the lines of a block gzip file in their order along the partitions."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def loaded(spark, kind: str, path: str, **options):
    """A frame of one of these sources, known to the session from now on."""
    for source in (BamSource, LineSource):
        spark.dataSource.register(source)
    return spark.read.format(kind).options(**options).load(path)
