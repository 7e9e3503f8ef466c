"""Lines of .xz, .lzma and .gzip archives, which Spark's own readers do not open, as a data source.

Nothing is held but a block of bytes and the lines cut from it, so an archive may be larger than a
worker's memory. An .xz file lists its blocks at its end; each of them is read by a task of its own, which
begins behind the first line end of its block and goes on to the first one of the next, as Hadoop's
readers do with splits. Other archives cannot be entered but at their start and are one task.

Files are opened through Arrow's file systems (local paths, and the stores whose addresses these know).
"""

from __future__ import annotations

import json
import lzma
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read, and bytes of lines sent, at once.
READ, SEND = 1 << 20, 4 << 20
#: Blocks of an .xz file are put together until a task has about so many bytes of text.
TASK = 64 << 20

LINES = "path string, split long, i long, value binary"
_MAGIC, _END = b"\xfd7zXZ\x00", b"YZ"


class Part(InputPartition):
    """Blocks of an archive: where they begin and end, and what stands before each stream's first one; None for all of it."""

    def __init__(self, path: str, split: int, blocks: list[tuple[int, int, bytes]] | None):
        super().__init__((path, split))
        self.path, self.split, self.blocks = path, split, blocks


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the lowest first, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if not byte & 128:
            return value, at


def xz_blocks(file, size: int) -> list[tuple[int, int, bytes, int]]:
    """(begin, end, stream's head, bytes of text) of each block of all streams, in order."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        got = file.read(n)
        if len(got) != n:
            raise ValueError("the archive ends early")
        return got

    found: list[tuple[int, int, bytes, int]] = []
    end = size
    while end:
        tail = read(end - 4, 4)
        if tail == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        foot = read(end - 12, 12)
        if foot[10:] != _END:
            raise ValueError("no .xz stream ends here")
        length = (struct.unpack("<I", foot[4:8])[0] + 1) * 4
        index = read(end - 12 - length, length)
        records, at = _number(index, 1)
        sizes = []
        for _ in range(records):
            packed, at = _number(index, at)
            plain, at = _number(index, at)
            sizes.append((-(-packed // 4) * 4, plain))
        begin = end - 12 - length - sum(s for s, _ in sizes)
        head = read(begin - 12, 12)
        if head[:6] != _MAGIC or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("no .xz stream begins here")
        blocks = []
        for packed, plain in sizes:
            blocks.append((begin, begin + packed, head, plain))
            begin += packed
        found = blocks + found
        end = end - 12 - length - sum(s for s, _ in sizes) - 12
    return found


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name), where.get_file_info(name).size


def _text_of_blocks(file, blocks: list[tuple[int, int, bytes]]) -> Iterator[bytes]:
    for begin, end, head in blocks:
        unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        unpack.decompress(head)
        file.seek(begin)
        while begin < end:
            data = file.read(min(READ, end - begin))
            if not data:
                raise ValueError("the archive ends early")
            begin += len(data)
            yield unpack.decompress(data, READ)
            while not unpack.needs_input and not unpack.eof:
                yield unpack.decompress(b"", READ)


def _text_behind(path: str, end: int) -> Iterator[bytes]:
    """Text of the blocks behind a place, which are listed only when it is asked for."""
    file, size = _opened(path)
    with file:
        yield from _text_of_blocks(file, [b[:3] for b in xz_blocks(file, size) if b[0] >= end])


def _text_of_stream(file, gzip: bool) -> Iterator[bytes]:
    """Text of all members of an archive that is read from its start."""
    make = (lambda: zlib.decompressobj(31)) if gzip else lzma.LZMADecompressor
    unpack, data = make(), file.read(READ)
    fresh = True
    while data:
        fresh = False
        out = unpack.decompress(data, READ)
        yield out
        if unpack.eof:
            data = unpack.unused_data.lstrip(b"\0") or file.read(READ)
            unpack, fresh = make(), True
        elif gzip:
            data = unpack.unconsumed_tail or file.read(READ)
        else:
            data = b"" if not unpack.needs_input else file.read(READ)
            while not data and not unpack.needs_input and not unpack.eof:
                yield unpack.decompress(b"", READ)
            if unpack.eof:
                data, unpack, fresh = unpack.unused_data.lstrip(b"\0") or file.read(READ), make(), True
            elif not data:
                data = file.read(READ)
    if not fresh:
        raise ValueError("the archive ends early")


def lines_of(text: Iterator[bytes], more: Iterator[bytes], first: bool) -> Iterator[list[bytes]]:
    """Lines that begin in ``text``, in lists of about ``SEND`` bytes; the last one may end in ``more``.

    Where ``text`` is not the ``first`` of a file, what stands before its first ``\\n`` belongs to the part before.
    """
    ends = re.compile(rb"\r\n|\n|\r")
    held, skipping, size = bytearray(), not first, 0
    lines: list[bytes] = []

    def cut(upto: int) -> None:
        nonlocal size
        part = bytes(held[:upto])
        del held[:upto]
        found = ends.split(part)
        lines.extend(found[:-1] if part.endswith((b"\n", b"\r")) else found)
        size += upto

    began = first
    for data in text:
        if skipping:
            at = data.find(b"\n")
            if at < 0:
                continue
            data, skipping = data[at + 1 :], False
        held += data
        if began and len(held) >= 3:
            if held.startswith(b"\xef\xbb\xbf"):
                del held[:3]
            began = False
        at = held.rfind(b"\n", max(0, len(held) - len(data)))
        if at >= 0 and not began:
            cut(at + 1)
        if size >= SEND:
            yield lines
            lines, size = [], 0
    if not skipping:
        for data in more:  # up to and with the next line end
            at = data.find(b"\n")
            held += data if at < 0 else data[: at + 1]
            if at >= 0:
                break
        if began and held.startswith(b"\xef\xbb\xbf"):
            del held[:3]
        if held:
            cut(len(held))
    if lines:
        yield lines


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Part]:
        parts = []
        for path in self.paths:
            if not path.lower().endswith(".xz"):
                parts.append(Part(path, 0, None))
                continue
            file, size = _opened(path)
            try:
                with file:
                    blocks = xz_blocks(file, size)
            except (ValueError, IndexError, struct.error):
                parts.append(Part(path, 0, None))  # the task tells what is wrong with it
                continue
            group, text = [], 0
            groups = []
            for begin, end, head, plain in blocks:
                group.append((begin, end, head))
                text += plain
                if text >= TASK:
                    groups.append(group)
                    group, text = [], 0
            groups += [group] if group else []
            parts += [Part(path, g[0][0], g) for g in groups]
        return parts or [Part("", 0, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        number = 0
        try:
            file, _ = _opened(part.path)
            with file:
                if part.blocks is None:
                    text, more = _text_of_stream(file, not re.search(r"(?i)\.(xz|lzma)$", part.path)), iter(())
                else:
                    text, more = _text_of_blocks(file, part.blocks), _text_behind(part.path, part.blocks[-1][1])
                for lines in lines_of(text, more, part.blocks is None or part.split == 12):
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.path] * n), pa.array([part.split] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(lines, pa.binary())],
                        names=["path", "split", "i", "value"],
                    )
                    number += n
        except (ValueError, EOFError, lzma.LZMAError, zlib.error) as e:
            raise ValueError(f"{part.path}: cannot be read as UTF-8 text ({e})") from e


class ArchiveLines(DataSource):
    """(path, split, i, value): the lines of the archives in the option ``paths``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "quillmill_archives"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))


def archive_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, split, i, value) of all lines of some archives, in order of (path, split, i); values are bytes."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planners may not see this library
    spark.dataSource.register(ArchiveLines)
    return spark.read.format(ArchiveLines.name()).option("paths", json.dumps(paths)).load()
