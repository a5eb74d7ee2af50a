import os

import pytest
from pyspark.sql import functions as F

from tabkit import convert, sinks
from tabkit.functions.separators import separator_spec


def contents(root):
    return {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_nested_folders(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "a b" / "ü%2F").mkdir(parents=True)
    (source / "top.txt").write_text('x|y\n1|"q\n')
    (source / "a b" / "same.txt").write_text("x|y\n2|3\n")
    (source / "a b" / "same.TXT").write_text("x|y\n4|5,6\n")
    (source / "a b" / "same.txt.txt").write_text("x|y\n0|0\n")
    (source / "a b" / "ü%2F" / "deep.v1.txt").write_text("x|y\n7\n8|9|10\n")
    (source / "a b" / "only.txt").write_text("header\n")
    (source / "none.txt").write_text("\n\n")
    (source / "empty.txt").write_text("")
    tree = convert.read_delimited_tree(spark, str(source))
    sinks.write_nested(tree, f"file:{out}")
    assert contents(out) == {
        "_SUCCESS": "",
        "top.csv": 'x,y\n1,"""q"\n',
        "a b/same.txt.csv": "x,y\n2,3\n",
        "a b/same.TXT.csv": 'x,y\n4,"5,6"\n',
        "a b/same.txt.txt.csv": "x,y\n0,0\n",
        "a b/ü%2F/deep.v1.csv": "x,y\n7,\n",
        "a b/only.csv": "header\n",
    }
    with pytest.raises(Exception, match="is not empty"):
        sinks.write_nested(tree, str(out))


def test_a_large_file_is_written_by_its_ranges(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "d").mkdir(parents=True)
    rows = "".join(f"{i}|{i * i}\n" for i in range(500))
    (source / "d" / "big.txt").write_text("\n" * 400 + "k|v\n" + rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        tree = convert.read_delimited_tree(spark, str(source))
        sinks.write_nested(tree, str(out))
        [(table, names)] = sinks.write_tables(tree, str(tmp_path / "tables"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    texts = contents(out / "d")
    assert len(texts) > 10 and texts["big.csv"].startswith("k,v\n0,0\n")
    assert "".join(texts[n] for n in sorted(texts)) == "k,v\n" + rows.replace("|", ",")
    assert names == ["k", "v"]
    assert sorted(int(r["k"]) for r in spark.read.parquet(table).collect()) == list(range(500))


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_the_number_of_jobs_does_not_grow_with_headers(spark, tmp_path):
    counts, tables = [], []
    for n in (2, 200):
        source = tmp_path / f"in{n}"
        source.mkdir()
        for i in range(n):
            (source / f"{i}.txt").write_text(f"k|v{i}\n{i}|NA\n")
        tree = convert.read_delimited_tree(spark, str(source))
        counts.append(jobs(spark, f"tables{n}", lambda: tables.append(sinks.write_tables(tree, str(tmp_path / f"out{n}")))))
        counts.append(jobs(spark, f"nested{n}", lambda: sinks.write_nested(tree, str(tmp_path / f"nested{n}"))))
        assert len(contents(tmp_path / f"nested{n}")) == n + 1
    assert counts[0] > 0 and counts[:2] == counts[2:]
    written = {tuple(names): path for path, names in tables[1]}
    assert set(written) == {("k", f"v{i}") for i in range(200)}
    for i in (0, 77, 199):
        folder = written["k", f"v{i}"]
        assert [tuple(r) for r in spark.read.parquet(folder).collect()] == [(str(i), str(i), "")]
        assert os.path.exists(f"{folder}/_SUCCESS")


def test_headers_without_rows_give_empty_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x|rel_path\n")
    tree = convert.read_delimited_tree(spark, str(tmp_path / "in"), separator_spec("|"))
    [(path, names)] = sinks.write_tables(tree, str(tmp_path / "out"))
    table = spark.read.parquet(path)
    assert names == ["x", "rel_path"] and table.columns == ["rel_path_", "x", "rel_path"] and table.count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.txt").write_text(f"a|b\n{i}|1\n")
    tree = convert.read_delimited_tree(spark, str(source))
    (source / "2.txt").unlink()
    with pytest.raises(Exception, match="no longer readable to its end"):
        sinks.write_nested(tree, str(tmp_path / "out"))
    assert contents(tmp_path / "out") == {}


def test_an_output_that_meets_a_folder_fails(spark, tmp_path):
    source = tmp_path / "in"
    (source / "n.csv").mkdir(parents=True)
    (source / "n.txt").write_text("a|b\n1|2\n")
    (source / "n.csv" / "m.txt").write_text("a|b\n1|2\n")
    tree = convert.read_delimited_tree(spark, str(source))
    with pytest.raises(Exception, match="n.csv"):
        sinks.write_nested(tree, str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tree = convert.read_delimited_tree(spark, str(tmp_path / "in"))
    sinks.write_nested(tree, str(tmp_path / "out"))
    assert contents(tmp_path / "out") == {"_SUCCESS": ""}
    assert sinks.write_tables(tree, str(tmp_path / "tables")) == []


def test_row_groups_are_flushed(spark, tmp_path, monkeypatch):
    from tabkit import tree_sink

    monkeypatch.setattr(tree_sink, "ROW_GROUP_BYTES", 1)
    system, path = tree_sink.file_system(str(tmp_path / "t"))
    table = tree_sink._Table(system, path, ["a", "b"])
    import pyarrow as pa

    for i in range(3):
        table.add(
            pa.RecordBatch.from_pydict(
                {"rel_path": ["f", "f"], "fields": pa.array([[str(i), "x"], None], pa.list_(pa.string()))}
            )
        )
    table.close()
    assert [tuple(r) for r in spark.read.parquet(path).sort("a").collect()] == [("f", str(i), "x") for i in range(3)]
