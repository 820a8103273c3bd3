import base64
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fieldglass.llm import warc

SF = "/root/testdata/sf0.01"


def brute(rows):
    best = {}
    for i, html in rows:
        p = (html or "").encode()
        best[p] = max(best.get(p, -1), -1 if i is None else i)
    out = []
    for i, html in rows:
        p = (html or "").encode()
        response = best[p] == -1 or i == best[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else best[p]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert rows_of(warc.op5(pages)) == brute([(r.page_id, r.html) for r in pages.collect()])


def test_edge_cases(spark):
    rows = [(1, "http://a b", "x"), (5, None, "x"), (2, "u", None), (3, "u", ""), (None, "u", "x"), (None, "v", "only"), (4, "u", "\r\n\r\nWARC/1.1\n\n"), (5, "u", "x"), (-7, "u", "é" * 100000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    assert rows_of(warc.op5(pages)) == brute([(r[0], r[2]) for r in rows])
    assert warc.op5(pages.limit(0)).count() == 0


def test_both_versions_and_many_files(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 30}</p>") for i in range(100)], "page_id long, url string, html string").repartition(4)
    arc, out = warc.new_path(spark, "arc"), warc.new_path(spark, "warc")
    warc.write_arc(pages, arc, records=10)
    versions = {b"\n1 0 " in data or data.split(b"\n")[1].startswith(b"1 ") for data in (warc._unzipped(bytes(r.content)) for r in warc._files(spark, arc).collect())}
    assert versions == {True, False}
    warc.convert(spark, arc, out)
    assert rows_of(warc.read_warc(spark, out)) == brute([(i, f"<p>{i % 30}</p>") for i in range(100)])


def test_declared_lengths_are_checked():
    data = warc.arc_version_block(1, "a") + b"\nhttp://x 0.0.0.0 20010101000000 text/html 99\nshort\n"
    with pytest.raises(ValueError, match="declares 99"):
        list(warc.parse_arc(data))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(b"http://x 0.0.0.0 20010101000000 text/html 5\nshort\n"))


@given(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)))
def test_identifiers_hold_the_page(page):
    assert warc.page_of(warc.record_id(page, warc.digest_of(b"x"))) == page


def test_large_pages_have_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, None, ("x" * 200_000 + str(i % 4)) if i % 3 == 0 else f"small {i % 5}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc, out = warc.new_path(spark, "arc"), warc.new_path(spark, "warc")
    warc.write_arc(pages, arc)
    assert max(len(warc._unzipped(bytes(r.content))) for r in warc._files(spark, arc).collect()) <= (1 << 20) + 210_000
    warc.convert(spark, arc, out)
    assert rows_of(warc.read_warc(spark, out)) == brute([(i, h) for i, _, h in rows])


def test_bytes_that_are_not_text(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u"), (2, "u")], "page_id long, url string").withColumn("html", F.unhex(F.lit("FFFE0D0AC328")))
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.op5(pages).collect()}
    assert got == {1: (6, "revisit"), 2: (6, "response")}
