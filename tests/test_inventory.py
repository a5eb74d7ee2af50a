"""File records, parts, summaries and sinks."""

import gzip
import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabkit import inventory, sinks
from tabkit.functions.files import categorise, part_title, relative_output_path
from tabkit.lookups import AUDIT_COLUMNS, CATEGORIES, INVENTORY_COLUMNS, ROWS_COLUMN
from tabkit.operators import parts
from tabkit.sources.file_tree import list_visible_files
from tabkit.sources.tables import as_text


def zip_bytes(*names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as package:
        for name in names:
            package.writestr(name, "x" * 50)
    return buffer.getvalue()


OFFICE = "application/vnd.openxmlformats-officedocument."
FILES = {
    "a.txt": (b"\x89PNG\r\n\x1a\n....", "image/png (png)"),
    "b.gz": (gzip.compress(b"hello"), "application/gzip (gz)"),
    "c.dat": (zip_bytes("a.txt"), "application/zip (zip)"),
    "d.zip": (zip_bytes("[Content_Types].xml", "word/document.xml"), f"{OFFICE}wordprocessingml.document (docx)"),
    "e.zip": (zip_bytes("[Content_Types].xml", "xl/workbook.xml"), f"{OFFICE}spreadsheetml.sheet (xlsx)"),
    "f g.PDF": (b"%PDF-1.4", "application/pdf (pdf)"),
    "h": (b"\xff\xd8\xff\xe0", "image/jpeg (jpg)"),
    "i.tar": (b"\x00" * 257 + b"ustar\x0000", "application/x-tar (tar)"),
    "j.wav": (b"RIFF\x00\x00\x00\x00WAVEfmt ", "audio/x-wav (wav)"),
    "k.txt": (b"plain text", "unknown"),
    "l.txt": (b"", "unknown"),
    "m.mp4": (b"\x00\x00\x00\x18ftypisom", "video/mp4 (mp4)"),
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan me")
    (root / "sub").mkdir()
    for i, (name, (data, _)) in enumerate(FILES.items()):
        (root / ("sub" if i % 2 else ".") / name).write_bytes(data)
    (root / "gone").symlink_to(root / "nowhere")
    return root


def test_scan_tree(spark, tree):
    records, audit = inventory.scan_tree(spark, str(tree))
    assert records.columns == inventory.RECORD
    got = {r["name"]: r for r in records.collect()}
    assert {n: r["detected"] for n, r in got.items()} == {n: d for n, (_, d) in FILES.items()}
    assert got["f g.PDF"]["ext"] == ".PDF" and got["f g.PDF"]["category"] == "办公文档"
    assert got["h"]["category"] == "其他"
    assert got["b.gz"]["folder"] == str(tree / "sub") and got["b.gz"]["path"] == str(tree / "sub" / "b.gz")
    assert all(r["created"] is not None and r["modified"] is not None for r in got.values())
    actions = [r[AUDIT_COLUMNS[1]] for r in audit.collect()]
    assert sorted(set(actions)) == ["扫描失败", "扫描完成"] and actions.count("扫描失败") == 1


def test_unreadable_head_is_an_error(spark):
    from tabkit.sources.file_tree import read_heads

    heads = read_heads(spark.createDataFrame([("/no/such/file",)], "path string"))
    row = heads.select(inventory.detection(F.col("head")), "head_error").first()
    assert row[0] == "error" and "No such file" in row[1]


def test_visible_listing_gives_the_same_records(spark, tree):
    listing = list_visible_files(spark, str(tree))
    got = {r["name"]: (r["folder"], r["size_mb"]) for r in inventory.file_records(listing).collect()}
    assert got.keys() == FILES.keys() - {"l.txt"}


def test_categorise_first_category_wins(spark):
    wanted = {}
    for category, extensions in CATEGORIES.items():
        for ext in extensions:
            wanted.setdefault(ext, category)
    rows = [(e,) for ext in wanted for e in (ext, ext.upper())] + [(".none",), ("",)]
    got = categorise(spark.createDataFrame(rows, "ext string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["category"] == wanted.get(r["ext"].lower(), "其他")


def records_of(spark, n):
    rows = [(f"/f/{i:05d}.{'zip' if i % 3 else 'pdf'}", i * 131072) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, length long")
    nothing = F.lit(None).cast("timestamp")
    return inventory.file_records(df.withColumns({"created": nothing, "modified": F.lit(datetime(2024, 1, 2, 3, 4, 5))}))


def test_parts_summary_and_total(spark):
    records = records_of(spark, 100)
    cut = parts.category_parts(records, 30)
    by_title = {}
    for r in cut.orderBy("path").collect():
        by_title.setdefault(r["title"], []).append(r["path"])
    assert {t: len(p) for t, p in by_title.items()} == {
        "办公文档_part1": 30, "办公文档_part2": 4, "压缩包_part1": 30, "压缩包_part2": 30, "压缩包_part3": 6,
    }
    assert max(by_title["压缩包_part1"]) < min(by_title["压缩包_part2"])
    sizes = {r["title"]: (r["files"], r["size_mb"]) for r in parts.category_summary(cut).collect()}
    for title, paths in by_title.items():
        want = round(sum(round(int(p[3:8]) * 0.125, 2) for p in paths), 2)
        assert sizes[title] == (len(paths), want)
    total = {r[0]: (r[1], r[2]) for r in parts.category_rollup(cut).collect()}
    assert total["总计"] == (100, round(sum(s for _, s in sizes.values()), 2))
    assert total.keys() == by_title.keys() | {"总计"}
    assert parts.row_limit(True) == 32765 and parts.row_limit(False) == 65530


def test_single_part_keeps_the_category_name(spark):
    titles = {r["title"] for r in parts.category_parts(records_of(spark, 10), 30).collect()}
    assert titles == {"办公文档", "压缩包"}
    df = spark.createDataFrame([("x" * 40, 2, 3)], "c string, p int, n int")
    assert df.select(part_title(F.col("c"), F.col("p"), F.col("n"))).first()[0] == "x" * 31


def test_rollup_of_nothing(spark):
    cut = parts.category_parts(records_of(spark, 3).limit(0), 30)
    assert [tuple(r) for r in parts.category_rollup(cut).collect()] in ([], [("总计", 0, 0.0)])


def test_write_category_parts(spark, tmp_path):
    sinks.write_category_parts(records_of(spark, 50), str(tmp_path / "out"), link_folder=True)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert {r["part"] for r in back.collect()} == {1}
    assert back.filter("folder_link = 'file:////f' AND link = concat('file:///', path)").count() == 50


def test_write_inventory_csv(spark, tmp_path):
    import csv

    records = records_of(spark, 3).withColumn("name", F.concat(F.lit(' "q", '), "name"))
    sinks.write_inventory_csv(records.coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    data = part.read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and b"\r\n" in data
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    assert rows[0] == [title for _, title in INVENTORY_COLUMNS]
    assert rows[1] == ["/f", ' "q", 00000.pdf', ".pdf", "", "2024-01-02 03:04:05", "0.0", "unknown", "/f/00000.pdf", "办公文档"]


def test_write_grouped_types(spark, tmp_path):
    from tabkit.operators.group import group_aggregate

    df = spark.createDataFrame([(1, "k", "(5)", "t")], "ord int, key string, amt string, txt string")
    sinks.write_grouped(group_aggregate(df, "key", ["amt"], ["ord"]), ["amt"], str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g"))
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [
        (ROWS_COLUMN, "bigint"), ("key", "string"), ("amt", "double"), ("txt", "string"),
    ]
    assert tuple(back.first()) == (1, "k", -5.0, "t")


def test_audit_is_appended(spark, tmp_path, tree):
    _, audit = inventory.scan_tree(spark, str(tree))
    for _ in range(2):
        sinks.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2 * (len(FILES) + 1)


def test_run_path():
    assert sinks.run_path("/out/", "扫描结果", datetime(2024, 1, 2, 3, 4, 5)) == "/out/扫描结果_20240102_030405"


def test_relative_output_path(spark):
    paths = ["/in/a.txt", "/in/s p/b.tar.gz", "/in/.hidden", "/in/x.y/noext"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.select(relative_output_path(F.col("p"), "/in/")).collect()]
    assert got == ["a", "s p/b.tar", ".hidden", "x.y/noext"]


def test_as_text(spark):
    df = spark.createDataFrame([(1, 2.5, "NA", " x "), (2, 1e9, "null", None)], "` id ` int, d double, s string, t string")
    assert [tuple(r) for r in as_text(df).collect()] == [("1", "2.5", None, " x "), ("2", "1000000000", None, None)]
    assert as_text(df).columns == ["id", "d", "s", "t"]
    assert as_text(df, blank_missing=False).first()["s"] == "NA"


def test_inventory_is_saved_with_summary_and_log(spark, tmp_path, tree):
    from tabkit.lookups import SAVED_TABLES, TOTAL_LABEL

    records, audit = inventory.scan_tree(spark, str(tree))
    out = str(tmp_path / "out")
    saved = sinks.write_inventory(records, audit, out)
    sinks.append_audit(saved, f"{out}/log")
    summary = {r[0]: r[1] for r in spark.read.parquet(f"{out}/summary").collect()}
    assert summary[TOTAL_LABEL] == records.count() == spark.read.parquet(f"{out}/parts").count()
    log = [r[AUDIT_COLUMNS[1]] for r in spark.read.parquet(f"{out}/log").collect()]
    assert len(log) == audit.count() + 1 and log.count(SAVED_TABLES) == 1
    assert audit.orderBy(*audit.columns).collect() == audit.orderBy(*audit.columns).collect()


def test_columns_of_one_stripped_name_are_refused(spark):
    from tabkit.sources.tables import as_text

    with pytest.raises(ValueError, match="stripped"):
        as_text(spark.createDataFrame([(1, 2)], "a int, `a ` int"))


@pytest.mark.parametrize("name", ["file_inventory", "encoding_resolve"])
def test_files_of_negative_and_null_ids(spark, tmp_path, name):
    from oracle import compare

    import duckdb
    from tabkit.plans import ORACLES, QUERIES

    texts = [(i, f"text {i} 中文") for i in [None, None, -1, -60, -120, 0, 49, 50, 120]]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_walk_hands_on_many_folders_beside_files(tmp_path, monkeypatch):
    import os

    import pandas as pd
    from tabkit.sources import file_tree

    for i in range(2130):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "f").write_bytes(b"x" * i)
        os.utime(tmp_path / str(i) / "f", ns=(0, 1_700_000_000_123_456_789 + i * 1_000_000_001))
    # The folders alone nearly reach the limit: 130 files, then 2000 folders left over.
    monkeypatch.setattr(file_tree, "WALK_ENTRIES", 2260)
    pending, rounds, found = pd.DataFrame({"path": [str(tmp_path)]}), 0, []
    while len(pending):
        rounds += 1
        listed = pd.concat(file_tree._walk(iter([pending])))
        found.append(listed[~listed["is_dir"].astype(bool)])
        pending = listed[listed["is_dir"].astype(bool)][["path"]]
    assert rounds == 2 and len(found[0]) == 130
    files = pd.concat(found)
    assert len(files) == files["path"].nunique() == 2130
    for path, length, modified in files[["path", "length", "modified"]].itertuples(index=False):
        i = int(path.split("/")[-2])
        assert length == i and modified == pd.Timestamp((1_700_000_000_123_456_789 + i * 1_000_000_001) // 1000, unit="us", tz="UTC")
