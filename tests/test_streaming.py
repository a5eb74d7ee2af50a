from collections import Counter

import pytest

from tabkit import streaming


def make_files(root, numbers, rows=5):
    (root / "sub dir").mkdir(parents=True, exist_ok=True)
    for i in numbers:
        folder = root / "sub dir" if i % 2 else root
        folder.joinpath(f"f{i}.txt").write_text("k|v\n" + "".join(f"{i}|{j}\n" for j in range(rows)) + "1|2|3\n")


def rows_of(spark, out):
    return Counter(tuple(r["fields"]) for r in streaming.read_chunks(spark, out).collect())


def expected(numbers, rows=5):
    return Counter((str(i), str(j)) for i in numbers for j in range(rows))


@pytest.mark.parametrize("stop_before", ["rows", "rejected", "status", None])
def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch, stop_before):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make_files(root, range(7))
    whole = streaming.write_chunk

    def dies(tree, path, number):
        """Chunk 1 dies before a part is written, or after all are and before the stream knows."""
        if number != 1:
            return whole(tree, path, number)
        for part in streaming.PARTS:
            if part == stop_before:
                break
            getattr(tree, part).write.mode("overwrite").parquet(f"{path}/{part}/chunk={number}")
        raise RuntimeError("lost")

    monkeypatch.setattr(streaming, "write_chunk", dies)
    with pytest.raises(Exception, match="lost"):
        streaming.convert_chunks(spark, str(root), out, checkpoint, files_per_chunk=3)
    seen = rows_of(spark, out)
    assert set(seen.values()) == {1} and len(seen) == (15 if stop_before else 30)
    monkeypatch.setattr(streaming, "write_chunk", whole)
    assert streaming.convert_chunks(spark, str(root), out, checkpoint, files_per_chunk=3) == 2
    assert rows_of(spark, out) == expected(range(7))
    assert streaming.read_chunks(spark, out, "rejected").count() == 7
    assert [r["status"] for r in streaming.read_chunks(spark, out, "status").collect()] == ["ok"] * 7


def test_later_files_only(spark, tmp_path):
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make_files(root, range(2))
    assert streaming.convert_chunks(spark, str(root), out, checkpoint) == 1
    assert streaming.convert_chunks(spark, str(root), out, checkpoint) == 0
    make_files(root, [2, 3])
    (root / "blank.txt").write_text("\n\n")
    assert streaming.convert_chunks(spark, str(root), out, checkpoint) == 1
    assert rows_of(spark, out) == expected(range(4))
    status = streaming.read_chunks(spark, out, "status").collect()
    assert Counter(r["status"] for r in status) == {"ok": 4, "failed": 1}
    assert {r["path"] for r in status} == {str(f) for f in root.rglob("*.txt")}


def test_chunks_of_a_batch_share_the_first_pass(spark, tmp_path, monkeypatch):
    from tabkit import convert

    passes, statistics = [], convert.line_statistics
    monkeypatch.setattr(convert, "line_statistics", lambda lines: passes.append(1) or statistics(lines))
    make_files(tmp_path / "in", range(5))
    out = str(tmp_path / "out")
    assert streaming.convert_chunks(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), files_per_chunk=2) == 3
    assert len(passes) == 1
    assert rows_of(spark, out) == expected(range(5))
    per_chunk = streaming.read_chunks(spark, out, "status").groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in per_chunk) == [1, 2, 2]


def test_a_repeated_chunk_is_never_half_seen(spark, tmp_path, monkeypatch):
    """Chunk 1 is whole but not marked, and stops again once its rows are being replaced;
    the last call asks for other chunks."""
    from tabkit.operators import delimited

    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    make_files(root, range(4))
    whole = streaming.write_chunk

    def lost_after(tree, path, number):
        whole(tree, path, number)
        if number:
            raise RuntimeError("lost")

    def lost_within(df, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(streaming, "write_chunk", lost_after)
    with pytest.raises(Exception, match="lost"):
        streaming.convert_chunks(spark, str(root), out, checkpoint, files_per_chunk=2)
    assert len(rows_of(spark, out)) == 20
    monkeypatch.setattr(streaming, "write_chunk", whole)
    with monkeypatch.context() as patch:
        patch.setattr(delimited, "rejected_rows", lost_within)
        with pytest.raises(Exception, match="lost"):
            streaming.convert_chunks(spark, str(root), out, checkpoint, files_per_chunk=2)
    assert streaming.read_chunks(spark, out, "status").select("chunk").distinct().count() == 1
    assert streaming.convert_chunks(spark, str(root), out, checkpoint, files_per_chunk=1) == 1
    assert rows_of(spark, out) == expected(range(4))
