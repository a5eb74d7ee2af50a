import random

import pytest
from oracle import compare, connect

from tabkit.llm import warc
from tabkit.llm.queries import ORACLES, QUERIES

SCHEMA = (
    "record_id long, uri string, captured_at long, record_type string, etag string, "
    "last_modified string, headers map<string,string>, status string"
)


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES["op8_warc"](spark, sf), connect(sf), ORACLES["op8_warc"])
    assert {r["status"] for r in QUERIES["op8_warc"](spark, sf).select("status").distinct().collect()} == {
        "resolved", "no_response", "etag_differs", "modified_differs",
    }


@pytest.mark.parametrize(
    "url, name",
    [
        ("HTTP://WWW.A.com:80/x/?b=2&a=1#f", "a.com/x/?a=1&b=2"),
        ("https://a.com", "a.com/"),
        ("https://a.com:8443//", "a.com:8443/"),
        ("a.com/no scheme ", "a.com/no scheme"),
        ("http://a.com/Case?&", "a.com/Case/"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, name):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(df["u"])).first()[0] == name


def resolved(spark, rows):
    df = warc.resolve_revisits(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    return {r["record_id"]: (r["status"], r["response_id"]) for r in df.collect()}


def test_validators_times_and_nulls(spark):
    u = "http://a.com/p"
    rows = [
        (1, u, 10, "response", '"x"', "mon", {}),
        (2, u, 10, "response", '"y"', "mon", {}),
        (2, u, 10, "response", None, None, None),
        (3, u, 10, "revisit", '"y"', None, None),
        (4, u, 11, "REVISIT", 'W/"y"', "ignored", None),
        (5, u, 11, "revisit", '"x"', None, None),
        (6, u, 11, "revisit", "", "mon", None),
        (7, u, 11, "revisit", None, " tue ", None),
        (8, u, 11, "revisit", None, None, None),
        (9, None, 11, "revisit", '"y"', None, None),
        (10, u, None, "revisit", '"y"', None, None),
        (11, u, 12, "metadata", '"y"', None, None),
        (None, u, 12, "response", '"z"', None, None),
        (12, u, 13, "revisit", '"y"', None, None),
        (13, "http://b.com/", 13, "revisit", '"y"', None, None),
    ]
    assert resolved(spark, rows) == {
        3: ("no_response", None), 4: ("resolved", 2), 5: ("etag_differs", 2), 6: ("resolved", 2),
        7: ("modified_differs", 2), 8: ("no_validator", 2), 9: ("no_response", None),
        10: ("no_response", None), 12: ("resolved", 2), 13: ("no_response", None),
    }


def test_one_url_over_many_slices(spark):
    rng = random.Random(1)
    rows, last, want = [], None, {}
    for at in range(3000):
        kind = "response" if rng.random() < 0.01 else "revisit"
        rows.append((at, "http://hot.com/", at, kind, '"t"', None, {}))
        if kind == "revisit":
            want[at] = ("resolved", last) if last is not None else ("no_response", None)
        else:
            last = at
    rng.shuffle(rows)
    assert resolved(spark, rows) == want


def test_merged_headers(spark):
    rows = [
        (1, "http://a/", 1, "response", "e", None, {"Content-Length": "9", "Date": "old", "X": "1", "x": "2"}),
        (2, "http://a/", 2, "revisit", "e", None, {"content-length": "0", "date": "new", "ETag": "e"}),
    ]
    df = warc.resolve_revisits(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert [tuple(e) for e in df.first()["headers"]] == [
        ("content-length", "9"), ("date", "new"), ("etag", "e"), ("x", "2"),
    ]


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
