"""Delimited text: options, headers, and whole trees compared with pandas' reader."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit import convert
from tabkit.functions.headers import repair_header
from tabkit.functions.separators import (
    ANY_WHITESPACE,
    AUTO,
    Separator,
    count_fields,
    is_blank_line,
    separator_spec,
    split_fields,
)
from tabkit.operators import delimited
from tabkit.sources.file_tree import list_files, list_visible_files
from tabkit import sinks

rng = random.Random(11)


def literal(text):
    return Separator("literal", text)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("", AUTO),
        ("space", ANY_WHITESPACE),
        ("空格", ANY_WHITESPACE),
        ("WhiteSpace", ANY_WHITESPACE),
        ("空白", ANY_WHITESPACE),
        (" ", literal(" ")),
        ("  ", literal("  ")),
        ("\\t", literal("\t")),
        ("Tab", literal("\t")),
        ("制表符", literal("\t")),
        ("\t", literal("\t")),
        ("||", literal("||")),
        (".", literal(".")),
        (" ; ", literal(" ; ")),
    ],
)
def test_separator_spec(raw, want):
    assert separator_spec(raw) == want


@pytest.mark.parametrize("sep", ["|", ",", ".", "\\", "^", "a", "5", "\t", " ", "  ", "||", "\\E", "::", "，", "$1"])
def test_split_is_literal(spark, sep):
    lines = [f"a{sep}b{sep}{sep}c", sep, "", f"{sep}x", f"x{sep}", "plain", f' "q{sep}r" ', f"{sep}{sep}"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    spec = literal(sep)
    for row in df.select("line", split_fields(F.col("line"), spec).alias("f"), count_fields(F.col("line"), spec).alias("n")).collect():
        text = row["line"].strip() if len(sep) > 1 else row["line"]
        assert row["f"] == text.split(sep)
        assert row["n"] == len(row["f"])


def test_split_whitespace(spark):
    lines = ["  a \t b　c ", "x", "", " ", "a b", "a\x1cb\x85c"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    for row in df.select("line", split_fields(F.col("line"), ANY_WHITESPACE).alias("f")).collect():
        assert row["f"] == (row["line"].split() or [""])


HEADERS = [
    ["a", "b", "c"],
    ["a", "a", "a"],
    ["a", "a", "a.1"],
    ["a.1", "a", "a"],
    ["", "x", ""],
    ["", "Unnamed: 0", "z"],
    ["x", " ", " "],
    ["a", "", "a", "", "a", "a.2", "a.2"],
    ["a", "a.1", "a", "a.1", "a"],
]


@pytest.mark.parametrize("names", HEADERS)
def test_header_repair_is_pandas(names):
    text = "|".join(names) + "\n" + "|".join("1" * len(names)) + "\n"
    want = list(pd.read_csv(io.StringIO(text), sep="|", dtype=str).columns)
    assert repair_header(names) == want


def pandas_read(data: bytes, sep, encoding):
    kwargs = dict(sep=r"\s+") if sep.kind == "whitespace" else dict(sep=sep.text)
    engine = "c" if sep.kind == "literal" and len(sep.text) == 1 and not sep.text.isspace() else "python"
    frame = pd.read_csv(
        io.BytesIO(data), encoding=encoding, dtype=str, header=0, skip_blank_lines=True,
        on_bad_lines="skip", quoting=csv.QUOTE_NONE, engine=engine, **kwargs,
    )
    return frame.fillna("")


def random_file(mark):
    """A header, then rows that may be short, long, blank, quoted or hold missing tokens.
    The first data row is never over-long."""
    cells = ["1", "x y", '"q', "NA", "", "null", "é", "中文", " pad ", "N/A", "5.0", "#N/A"]
    width = rng.randrange(2, 5)
    lines = [mark.join(f"h{i}" if rng.random() < 0.8 else "h" for i in range(width))]
    lines.append(mark.join(["r"] * width))
    for _ in range(rng.randrange(0, 40)):
        kind = rng.random()
        n = width if kind < 0.7 else rng.randrange(1, width + 2)
        lines.append(rng.choice(["", "  ", " "]) if kind > 0.93 else mark.join(rng.choice(cells) for _ in range(n)))
    blank_first = [""] * rng.randrange(0, 3)
    return "".join(line + rng.choice(["\n", "\r\n"]) for line in blank_first + lines)


def by_path(tree):
    headers = {r["path"]: r for r in tree.files.collect()}
    rows = {}
    for r in tree.rows.orderBy("path", "block", "line_id").collect():
        rows.setdefault(r["path"], []).append(list(r["fields"]))
    return headers, rows


@pytest.mark.parametrize("mark", ["|", ",", "\t", ";", " ", "  ", "::", "whitespace"])
def test_tree_with_given_separator_is_pandas(spark, tmp_path, mark):
    sep = separator_spec(mark)
    files = {}
    for i in range(12):
        text = random_file("\t " if mark == "whitespace" else sep.text)
        if mark in ("whitespace", " ", "  "):
            text = text.replace("x y", "x_y").replace(" pad ", "pad")
        encoding = ["utf-8", "utf-8-sig", "gb18030"][i % 3]
        path = tmp_path / f"d{i % 4}" / f"f {i}+%41.{'TXT' if i % 2 else 'txt'}"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode(encoding))
        try:
            files[str(path)] = pandas_read(path.read_bytes(), sep, encoding)
        except pd.errors.ParserError:
            path.write_bytes(b"")
    (tmp_path / "other.csv").write_text("no|text\n")
    tree = convert.read_delimited_tree(spark, str(tmp_path), sep)
    headers, rows = by_path(tree)
    for path, want in files.items():
        assert headers[path]["names"] == list(want.columns), path
        assert rows.get(path, []) == want.values.tolist(), path
    counts = {(r["path"], r["kind"]): r["count"] for r in tree.split.groupBy("path", "kind").count().collect()}
    for path, file in headers.items():
        assert sum(n for (p, _), n in counts.items() if p == path) == file["n_lines"]
        assert counts[(path, "header")] == 1


def test_auto_detection(spark, tmp_path):
    cases = {
        "tab": ("a\tb\n1\t2\n", "\t", ["a", "b"], [["1", "2"]]),
        "pipe": ("a|b\n1|2,3\n", "|", ["a", "b"], [["1", "2,3"]]),
        "comma": ("a,b\n1,2\n", ",", ["a", "b"], [["1", "2"]]),
        "semicolon": ("a;b\n1;2\n", ";", ["a", "b"], [["1", "2"]]),
        "spaces": ("a  b\n1  2\n", "whitespace", ["a", "b"], [["1", "2"]]),
        "one_column": ("a\nx y\nz\n", "\t", ["a"], [["x y"], ["z"]]),
        "header_only": ("a,b\n", "\t", ["a,b"], []),
        "blank_lines": ("\n  \n\t\n", "\t", ["Unnamed: 0", "Unnamed: 1"], []),
        "late_comma": ("a\n" + "x\n" * 60 + "p,q\n", "\t", ["a"], None),
        "early_comma": ("a\n" + "x\n" * 40 + "p,q\n", ",", ["a"], [["x"]] * 40),
        "one_field_header": ("a\n1|2,3\n4|5,6\n", None, None, None),
        "only_blank": ("\n \n  \n", None, None, None),
        "empty": ("", None, None, None),
        # Past the sample of lines: what decides lies further down.
        "deep_header": ("\n" * 300 + "a;b\n1;2\n", ";", ["a", "b"], [["1", "2"]]),
        "deep_rows": ("a,b\n" + "1,2,3\n" * 300 + "7,8\n", ",", ["a", "b"], [["7", "8"]]),
        "deep_single": ("a\n" + "1,2\n" * 300 + "x\n" * 60, ",", ["a"], [["x"]] * 60),
        "deep_only_blank": (" \n" * 300, None, None, None),
    }
    for name, (text, *_) in cases.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    headers, rows = by_path(tree)
    status = {r["path"]: r for r in tree.status.collect()}
    assert len(status) == len(cases)
    for name, (_, mark, names, want) in cases.items():
        path = str(tmp_path / f"{name}.txt")
        assert status[path]["separator"] == mark, name
        assert status[path]["status"] == ("failed" if mark is None else "ok"), name
        if mark is not None:
            assert headers[path]["names"] == names, name
        if want is not None:
            assert rows.get(path, []) == want, name
    totals = delimited.status_totals(tree.status).first()
    assert (totals["total"], totals["ok"], totals["failed"]) == (17, 13, 4)
    rejected = {r["path"].split("/")[-1] for r in tree.rejected.collect()}
    assert rejected == {"early_comma.txt", "deep_rows.txt", "deep_single.txt"}


def test_encodings(spark, tmp_path):
    texts = {
        "utf8.txt": ("名|b\n中|2\n", "utf-8", "utf-8"),
        "bom.txt": ("名|b\n中|2\n", "utf-8-sig", "utf-8"),
        "gb.txt": ("名|b\n中|丂\n𠀀|2\n", "gb18030", "gb18030"),
        "latin.txt": ("n|b\nà\n", "latin1", "latin1"),
        "ascii.txt": ("n|b\nx|y\n", "ascii", "utf-8"),
    }
    for name, (text, encoding, _) in texts.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    tree = convert.read_delimited_tree(spark, str(tmp_path), separator_spec("|"))
    headers, rows = by_path(tree)
    for name, (text, _, want) in texts.items():
        path = str(tmp_path / name)
        lines = text.splitlines()
        assert headers[path]["encoding"] == want
        assert headers[path]["header"] == lines[0].split("|")
        assert rows[path] == [(line + "|" * (1 - line.count("|"))).split("|") for line in lines[1:]]


def test_over_long_first_row_is_rejected_not_shifted(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a|b\n1|2|3\n4|5\n")
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    _, rows = by_path(tree)
    assert list(rows.values()) == [[["4", "5"]]]
    assert [r["line"] for r in tree.rejected.collect()] == ["1|2|3"]


def test_hidden_names_are_read_too(spark, tmp_path):
    (tmp_path / "_sub %41").mkdir()
    (tmp_path / "_sub %41" / ".h+.txt").write_bytes("\ufeff名|b\r\n1|中\r2|\n".encode())
    (tmp_path / "_gb.txt").write_bytes("名|b\n丂|2\n".encode("gb18030"))
    (tmp_path / "seen.txt").write_text("a|b\n1|2")
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    headers, rows = by_path(tree)
    assert rows == {
        str(tmp_path / "_sub %41" / ".h+.txt"): [["1", "中"], ["2", ""]],
        str(tmp_path / "_gb.txt"): [["丂", "2"]],
        str(tmp_path / "seen.txt"): [["1", "2"]],
    }
    assert headers[str(tmp_path / "_gb.txt")]["names"] == ["名", "b"]
    assert {r["status"] for r in tree.status.collect()} == {"ok"}
    assert sorted(map(tuple, tree.table(["名", "b"]).collect())) == [("1", "中"), ("2", ""), ("丂", "2")]


def test_large_file_is_read_in_blocks(spark, tmp_path):
    lines = ["id,v"] + [f"{i},{'x' * (i % 50)}" for i in range(20_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
    try:
        tree = convert.read_delimited_tree(spark, str(tmp_path))
        assert tree.split.select("block").distinct().count() > 4
        _, rows = by_path(tree)
        assert next(iter(rows.values())) == [line.split(",") for line in lines[1:]]
        kinds = {r["kind"]: r["count"] for r in tree.split.groupBy("kind").count().collect()}
        assert kinds == {"header": 1, "row": 20_000}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blank_line_rules(spark):
    cases = [
        (literal("|"), "  \t", True), (literal("|"), "|", False), (literal("|"), "　", False),
        (literal("\t"), "\t\t", False), (literal("\t"), "  ", True), (literal(" "), "  ", False),
        (literal("  "), "  ", True), (ANY_WHITESPACE, "\t　", True), (ANY_WHITESPACE, "x", False),
    ]
    for sep, line, want in cases:
        df = spark.createDataFrame([(line,)], "line string")
        assert df.select(is_blank_line(F.col("line"), sep)).first()[0] is want, (sep, line)


def test_listing(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.txt").write_bytes(b"12345")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"h")
    (tmp_path / "_under").mkdir()
    (tmp_path / "_under" / "y").write_bytes(b"yy")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "loop").symlink_to(tmp_path)
    found = {r["path"].removeprefix(str(tmp_path)): r for r in list_files(spark, str(tmp_path)).collect()}
    assert {p: r["length"] for p, r in found.items()} == {
        "/a b/x.txt": 5, "/empty.bin": 0, "/.hidden": 1, "/_under/y": 2, "/broken": None,
    }
    assert [p for p, r in found.items() if r["status"] == "failed"] == ["/broken"]
    modified = found["/a b/x.txt"]["modified"]
    import os

    assert abs(modified.timestamp() - os.stat(tmp_path / "a b" / "x.txt").st_mtime) < 0.001
    visible = {r["path"].removeprefix(str(tmp_path)) for r in list_visible_files(spark, str(tmp_path)).collect()}
    assert "/a b/x.txt" in visible and "/empty.bin" not in visible


def test_remote_listing(tmp_path):
    """The branch for URIs, tried on a local one."""
    from tabkit.sources.file_tree import _remote_entries, open_file

    (tmp_path / "sub").mkdir()
    (tmp_path / "x.txt").write_bytes(b"123")
    root = f"file://{tmp_path}"
    found = {e[0]: e for e in _remote_entries(root)}
    assert found[f"{root}/sub"][1] is True
    assert found[f"{root}/x.txt"][1:4] == (False, 3, None)
    assert found[f"{root}/x.txt"][4] == (tmp_path / "x.txt").stat().st_mtime_ns
    with open_file(f"{root}/x.txt") as stream:
        assert stream.read(2) == b"12"


def test_tree_root(spark):
    from tabkit.sources.file_tree import tree_root

    roots = ["/a/b/", "file:///a/b", "file:/a/b", "hdfs://n/a/"]
    assert [tree_root(spark, r) for r in roots] == ["/a/b", "/a/b", "/a/b", "hdfs://n/a"]


def test_listing_hands_directories_on(spark, tmp_path, monkeypatch):
    from tabkit.sources import file_tree

    monkeypatch.setattr(file_tree, "WALK_ENTRIES", 5)
    for i in range(6):
        for j in range(4):
            folder = tmp_path / f"d{i}" / f"e{j}"
            folder.mkdir(parents=True)
            (folder / "f").write_bytes(b"x")
    paths = [r["path"] for r in list_files(spark, str(tmp_path)).collect()]
    assert len(paths) == len(set(paths)) == 24


def test_write_tables_and_mirrored(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub dir").mkdir(parents=True)
    (source / "one.txt").write_text('a,b\n1,"x\n3,4\n')
    (source / "sub dir" / "two.txt").write_text("a|b\n5|6,7\n8\n9|9|9\n")
    (source / "three.TXT").write_text("p;p;\n1;2;NA\n")
    (source / "case.txt").write_text("A|a|rel_path\nx|y|z\n")
    tree = convert.read_delimited_tree(spark, str(source))
    tables = sinks.write_tables(tree, str(tmp_path / "tables"))
    assert sorted(names for _, names in tables) == [["A", "a", "rel_path"], ["a", "b"], ["p", "p.1", "Unnamed: 2"]]
    got = {}
    for path, names in tables:
        if "A" in names:
            with sinks._case_sensitive(spark, True):
                row = spark.read.parquet(path).first()
                assert [row[n] for n in names] == ["x", "y", "z"] and row["rel_path_"] == "case"
            continue
        for row in spark.read.parquet(path).collect():
            got.setdefault(row["rel_path"], []).append([row[n] for n in names])
    assert got == {"one": [["1", '"x'], ["3", "4"]], "sub dir/two": [["5", "6,7"], ["8", ""]], "three": [["1", "2", ""]]}
    sinks.write_mirrored(tree, str(tmp_path / "mirror"))
    texts = {
        r["rel_path"]: r["value"]
        for r in spark.read.text(str(tmp_path / "mirror"), wholetext=True).collect()
    }
    assert texts == {
        "case": "A,a,rel_path\nx,y,z\n",
        "one": 'a,b\n1,"""x"\n3,4\n',
        "sub dir/two": 'a,b\n5,"6,7"\n8,\n',
        "three": "p,p.1,Unnamed: 2\n1,2,\n",
    }


def test_partition_folders_are_read_once(spark, tmp_path):
    (tmp_path / "_p=1").mkdir()
    (tmp_path / "_p=1" / "a.txt").write_text("a|b\n1|2\n3|4\n")
    (tmp_path / "dead.txt").symlink_to(tmp_path / "nowhere")
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    kinds = {r["kind"]: r["count"] for r in tree.split.groupBy("kind").count().collect()}
    assert kinds == {"header": 1, "row": 2}
    status = {r["path"].removeprefix(str(tmp_path)): r for r in tree.status.collect()}
    assert {p: r["status"] for p, r in status.items()} == {"/_p=1/a.txt": "ok", "/dead.txt": "failed"}
    assert "No such file" in status["/dead.txt"]["note"]


def test_split_settings_may_change_before_the_action(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.txt").write_text(f"a|b\n{i}|1\n{i}|2\n{i}|3\n")
    tree = convert.read_delimited_tree(spark, str(tmp_path))
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, value in zip(names, ("64", "1", "50")):
            spark.conf.set(n, value)
        kinds = {r["kind"]: r["count"] for r in tree.split.groupBy("kind").count().collect()}
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
    assert kinds == {"header": 12, "row": 36}


def test_detection_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "few.txt").write_text("a,b\n" + "1,2,3\n" * 5 + "4,5\n" * 100)
    (tmp_path / "wide.txt").write_text("a;b\n" + "x" * 70_000 + ";y\n1;2\n")
    (tmp_path / "wider.txt").write_text("h" * 70_000 + "|b\n1|2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for size in (before, "32"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            tree = convert.read_delimited_tree(spark, str(tmp_path))
            results.append((
                sorted((r["path"], r["separator"], r["status"]) for r in tree.files.collect()),
                {r["kind"]: r["count"] for r in tree.split.groupBy("kind").count().collect()},
            ))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert results[0] == results[1]
    assert results[0][1] == {"header": 3, "row": 103, "rejected": 5}


def test_outputs_do_not_merge_inputs(spark, tmp_path):
    source = tmp_path / "in"
    (source / "a" / "b").mkdir(parents=True)
    (source / "same.txt").write_text("x|y\n1|2\n")
    (source / "same.TXT").write_text("x|y\n3|4\n")
    (source / "a" / "b" / "n.txt").write_text("x|y\n5|6\n")
    tree = convert.read_delimited_tree(spark, f"file:{source}")
    sinks.write_mirrored(tree, str(tmp_path / "mirror"))
    texts = {r["rel_path"]: r["value"] for r in spark.read.text(str(tmp_path / "mirror"), wholetext=True).collect()}
    assert texts == {"same.txt": "x,y\n1,2\n", "same.TXT": "x,y\n3,4\n", "a/b/n": "x,y\n5,6\n"}
    [(path, _)] = sinks.write_tables(tree, str(tmp_path / "tables"))
    assert {r["rel_path"]: r["x"] for r in spark.read.parquet(path).collect()} == {"same.txt": "1", "same.TXT": "3", "a/b/n": "5"}
    assert [f.name for f in (tmp_path / "tables").iterdir()] == [path.rsplit("/", 1)[1]]


def test_paths_outside_the_root_are_refused(spark):
    from tabkit.functions.files import relative_output_path

    df = spark.createDataFrame([("hdfs://nn:8020/data/sub/a.txt",)], "p string")
    assert df.select(relative_output_path(F.col("p"), "hdfs://nn:8020/data")).first()[0] == "sub/a"
    with pytest.raises(Exception, match="is not below /data/"):
        df.select(relative_output_path(F.col("p"), "/data")).collect()


def test_preview_of_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("a|b\n" + "".join(f"{j}|{i}\n" for j in range(20)))
    rows = convert.read_delimited_tree(spark, str(tmp_path)).preview(2).collect()
    assert sorted(r["fields"] for r in rows) == sorted([str(j), str(i)] for i in range(3) for j in range(2))


def test_staged_tables_go_with_their_scope(spark, tmp_path):
    from pathlib import Path

    from tabkit.session import staging

    (tmp_path / "a.txt").write_text("a|b\n1|2\n")
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(base.iterdir())
    with staging(spark):
        assert convert.read_delimited_tree(spark, str(tmp_path)).rows.count() == 1
        assert set(base.iterdir()) > before
    assert set(base.iterdir()) == before


def test_only_local_threads_get_a_folder_of_their_own():
    from types import SimpleNamespace

    from tabkit.session import scratch_path

    conf = SimpleNamespace(get=lambda key, default: default)
    for master, fits in (("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fits:
            assert "tabkit-" in scratch_path(session, "x")
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                scratch_path(session, "x")
