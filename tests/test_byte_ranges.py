import random
import re

import pytest

from tabkit import convert, sinks
from tabkit.operators.delimited import status_totals
from tabkit.sources import byte_ranges
from tabkit.sources.byte_ranges import Truncated, range_lines
from tabkit.sources.file_tree import list_files


def plain(data):
    """Lines by their definition, with where they begin."""
    out, begin = [], 0
    for stop in re.finditer(rb"\r\n|\r|\n", data):
        out.append((begin, data[begin : stop.start()]))
        begin = stop.end()
    if begin < len(data):
        out.append((begin, data[begin:]))
    if out and out[0][1].startswith(b"\xef\xbb\xbf"):
        out[0] = (0, out[0][1][3:])
    return out


@pytest.mark.parametrize("step", [16, 64, 1 << 20])
def test_ranges_give_every_line_once(tmp_path, monkeypatch, step):
    monkeypatch.setattr(byte_ranges, "READ_BYTES", step)
    rng = random.Random(step)
    for case in range(300):
        pieces = [b"\n", b"\r", b"\r\n", b"", b"a", b"bc", b"\xef\xbb\xbf", b"x" * rng.choice([5, 40, 200])]
        data = b"".join(rng.choices(pieces, k=rng.randint(1, 30)))
        if not data:
            continue
        path = tmp_path / f"{case}"
        path.write_bytes(data)
        size = rng.choice([1, 2, 3, 7, 50, 10_000])
        for start in range(0, len(data), size):
            end = min(len(data), start + size)
            got = [line for part in range_lines(str(path), start, end) for line in part.to_pylist()]
            assert got == [line for begin, line in plain(data) if start <= begin < end], (data, start, end)


def test_truncated_and_missing_raise(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"ab\ncd\n")
    with pytest.raises(Truncated):
        list(range_lines(str(path), 0, 7))
    with pytest.raises(Truncated):
        list(range_lines(str(path), 7, 20))
    with pytest.raises(FileNotFoundError):
        list(range_lines(str(tmp_path / "b"), 0, 7))


def make_tree(tmp_path, n=6):
    for i in range(n):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"{i}.txt").write_text("a|b\n" + "".join(f"{i}|{j}\n" for j in range(50)))


def test_files_that_fail_while_read_get_a_status(spark, tmp_path):
    make_tree(tmp_path)
    listing = list_files(spark, str(tmp_path))
    assert listing.count() == 6
    (tmp_path / "d0" / "0.txt").unlink()
    (tmp_path / "d1" / "1.txt").write_text("a|b\n1|2\n")
    (tmp_path / "d0" / "2.txt").unlink()
    (tmp_path / "d0" / "2.txt").mkdir()
    tree = convert.read_listed(listing, str(tmp_path))
    status = {r["path"].removeprefix(str(tmp_path)): (r["status"], r["note"]) for r in tree.status.collect()}
    assert {p: s for p, (s, _) in status.items()} == {
        "/d0/0.txt": "failed", "/d1/1.txt": "failed", "/d0/2.txt": "failed", "/d1/3.txt": "ok", "/d0/4.txt": "ok", "/d1/5.txt": "ok",
    }
    assert "No such file" in status["/d0/0.txt"][1] and "ends before byte" in status["/d1/1.txt"][1] and "directory" in status["/d0/2.txt"][1]
    assert tuple(status_totals(tree.status).first()) == (6, 3, 3)
    rows = [(r["path"].rsplit("/", 1)[1], *r["fields"]) for r in tree.rows.collect()]
    assert sorted(rows) == sorted((f"{i}.txt", str(i), str(j)) for i in (3, 4, 5) for j in range(50))
    sinks.write_tables(tree, str(tmp_path / "out"))


def test_one_bad_range_fails_the_whole_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a|b\n" + "1|2\n" * 400)
    (tmp_path / "b.txt").write_text("a|b\n" + "1|2\n" * 400)
    listing = list_files(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("a|b\n" + "1|2\n" * 300)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        tree = convert.read_listed(listing, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["path"][-5:]: r["status"] for r in tree.status.collect()} == {"a.txt": "failed", "b.txt": "ok"}
    assert tree.rows.count() == 400


def test_a_file_lost_between_the_passes_fails_the_job(spark, tmp_path):
    make_tree(tmp_path, 2)
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    (tmp_path / "d0" / "0.txt").unlink()
    with pytest.raises(Exception, match="no longer readable to its end"):
        tree.rows.collect()


def test_only_failing_files(spark, tmp_path):
    make_tree(tmp_path, 1)
    listing = list_files(spark, str(tmp_path))
    (tmp_path / "d0" / "0.txt").unlink()
    tree = convert.read_listed(listing, str(tmp_path))
    assert [r["status"] for r in tree.status.collect()] == ["failed"] and tree.rows.count() == 0


def test_range_size_follows_the_setting(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for text, size in (("100", 100), ("16m", 16 << 20), ("128MB", 128 << 20), ("134217728b", 1 << 27), ("1g", 1 << 30)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", text)
            assert byte_ranges.range_bytes(spark) == size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
