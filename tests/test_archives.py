"""Archives read by blocks and as streams, in pieces that need no whole archive."""

import gzip
import lzma
import random
import shutil
import subprocess

import pytest

from quillmill.errors import FormatError
from quillmill.sources import archives, readers


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(1)
    return ["".join(rng.choice("abcé€ x") for _ in range(rng.choice([0, 3, 40, 3000]))) for _ in range(800)]


def written(folder, lines, end="\n"):
    text = ("﻿" + end.join(lines) + end).encode()
    made = {
        "streams.xz": b"".join(lzma.compress(text[a : a + 70_000]) + b"\0" * (8 * (a > 0)) for a in range(0, len(text), 70_000)),
        "one.xz": lzma.compress(text), "old.lzma": lzma.compress(text, lzma.FORMAT_ALONE), "members.gzip": gzip.compress(text[:50_000]) + gzip.compress(text[50_000:]),
    }
    if shutil.which("xz"):
        made["blocks.xz"] = subprocess.run(["xz", "--block-size=40000", "-c"], input=text, capture_output=True, check=True).stdout
    for name, data in made.items():
        (folder / name).write_bytes(data)
    return made


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_pieces_of_archives(tmp_path, monkeypatch, lines, end):
    """Lines over the ends of blocks are read once; what is held stays near the pieces' size."""
    monkeypatch.setattr(archives, "TASK", 100_000)
    monkeypatch.setattr(archives, "SEND", 50_000)
    monkeypatch.setattr(archives, "READ", 7_000)
    for name, data in written(tmp_path, lines, end).items():
        reader = archives._Reader([str(tmp_path / name)])
        parts = reader.partitions()
        assert (len(parts) > 3) == (name in ("streams.xz", "blocks.xz"))
        batches = [b for part in parts for b in reader.read(part)]
        assert [v.as_py().decode() for b in batches for v in b.column(3)] == lines, name
        assert max(b.nbytes for b in batches) < 250_000
        (tmp_path / name).write_bytes(data[: len(data) // 2])
        with pytest.raises(ValueError, match="cannot be read"):
            [b for part in reader.partitions() for b in reader.read(part)]


def test_datasets_in_archives(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(archives, "TASK", 100_000)
    made = written(tmp_path, [x.strip() for x in lines])
    want = [(i + 1, x.strip()) for i, x in enumerate(lines) if x.strip()]
    for name in made:
        got = readers.read_jsonl(spark, str(tmp_path / name))
        assert [(r.line_no, r.raw) for r in got.orderBy("line_no").collect()] == want, name
    table = "q;a\n" + "".join(f'{i};"x\n{i}"\n' for i in range(200))
    (tmp_path / "t.csv.xz").write_bytes(lzma.compress(table.encode()))
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "t.csv.xz")).collect()] == [(str(i), f"x\n{i}") for i in range(200)]
    for name, data in (("bad.xz", b"no archive"), ("bad.gzip", gzip.compress(b"\xff\xfe\n"))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(FormatError):
            readers.read_jsonl(spark, str(tmp_path / name)).collect()
