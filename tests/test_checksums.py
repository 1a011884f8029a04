import os
import zlib

from scoreloom.sources import checksums as cs


def test_moved_sums_add_up():
    head, tail = os.urandom(1234), os.urandom(777)
    assert cs.moved(zlib.crc32(head), len(tail)) ^ zlib.crc32(tail) == zlib.crc32(head + tail)
    assert cs.moved(zlib.crc32(head), 0) == zlib.crc32(head) and cs.moved(0, 10) == 0


def test_ranges_give_the_plain_checksum(spark, tmp_path):
    """Empty, short and long files, ranges that end with the file and inside it, a name with a blank."""
    data = {"empty": b"", "one": b"x", "whole parts": os.urandom(3000), "rest.bin": os.urandom(10_001), "zeros": bytes(5000)}
    (tmp_path / "in").mkdir()
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    for part in (1000, 1 << 20):
        found = {os.path.basename(r["path"]).replace("%20", " "): (r["length"], r["crc32"]) for r in cs.file_crc32(spark, str(tmp_path), part).collect()}
        assert found == {name: (len(content), zlib.crc32(content)) for name, content in data.items() if content}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: the zeros before its last bytes take no disk."""
    size, tail = (2 << 30) + 4096, b"the end"
    with open(tmp_path / "long", "wb") as file:
        file.seek(size)
        file.write(tail)
    crc, block = 0, bytes(1 << 20)
    for _ in range(size >> 20):
        crc = zlib.crc32(block, crc)
    crc = zlib.crc32(tail, zlib.crc32(bytes(size % (1 << 20)), crc))
    row = cs.file_crc32(spark, str(tmp_path)).first()
    assert (row["length"], row["crc32"]) == (size + len(tail), crc)
