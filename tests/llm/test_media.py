import hashlib
import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from fieldglass.llm import media

SF = "/root/testdata/sf0.001"


def brute(text):
    data = (text or "").encode()
    p = data + b"\xff" * (-len(data) % 576)
    p = p or b"\xff" * 576
    return len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def check(docs):
    out = media.op1(docs)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out.collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    return out


def test_documents_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = check(docs).toPandas()
    assert (out.caption == [f"Text of document {i}" for i in out.doc_id]).all()
    by_payload = out.groupby("payload_sha256")[["media_sha256", "media_bytes", "feature"]].nunique()
    assert (by_payload == 1).all().all()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (4, "é" * 400000), (5, "a" * 576), (6, "a" * 577)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, row_key string, digest int")
    check(docs)
    assert media.op1(docs.limit(0)).count() == 0


@given(st.binary(max_size=3000))
def test_image_keeps_every_byte(data):
    payload = media.payload_of(data)
    assert media.samples(media.png(payload)).tobytes() == payload


def test_items_keep_order_and_captions():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><p>one <b>two</b><figure><img src="a" alt="x">
    <img src="b"><figcaption>both &amp; more</figcaption></figure>three<p>four<video src="v" title="film"></video><figure><figcaption>alone</figcaption></figure><img alt="no source"></body>"""
    got = [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.items_of(page)]
    assert got == [(0, "text", "T", None), (1, "text", "one two", None), (2, "image", "a", "both & more"), (3, "image", "b", "both & more"), (4, "text", "three", None), (5, "text", "four", None), (6, "video", "v", "film"), (7, "text", "alone", None)]
    assert media.items_of(None) == [] and media.items_of("<figure><img src=q><figcaption>open")[0]["caption"] == "open"


def test_resolve_aligns_what_it_finds(spark):
    pages = spark.createDataFrame([(1, "<p>a<img src='urn:sha256:d1' alt=c1><p>b<img src='urn:sha256:none' alt=c2><img src='http://x' alt=c3><img src='urn:sha256:d1' alt=c4>"), (2, None), (3, "<p>only")], "page_id long, html string")
    held = spark.createDataFrame([("d1", b"payload"), ("d2", b"other")], "digest string, payload binary")
    out = {r.page_id: r["items"] for r in media.resolve(media.parse_html(pages, "page_id"), held, "page_id").collect()}
    assert [(x.kind, x.caption, x.media and bytes(x.media.payload)) for x in out[1]] == [("text", None, None), ("image", "c1", b"payload"), ("text", None, None), ("image", "c2", None), ("image", "c3", None), ("image", "c4", b"payload")]
    assert out[2] == [] and out[3][0].text == "only"


def test_real_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in media.parse_html(pages, "page_id").collect():
        assert [x.pos for x in r["items"]] == list(range(len(r["items"]))) and not any("var t=" in (x.text or "") for x in r["items"])


def test_feature_is_of_the_samples():
    assert media.feature_of(np.zeros((1, 576), np.uint8)) == "576x1:" + "00" * 64
