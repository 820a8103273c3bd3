import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.llm import packing

SF = "/root/testdata/sf0.001"


def reference_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def own_tokenizer():
    import public_tokenizers as P

    return packing.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_rows_agree_with_the_tokenizer_file(spark):
    t = reference_tokenizer()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.op6(docs).toPandas()
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        own = out[out.doc_id == r.doc_id].sort_values("piece")
        assert list(own.piece) == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 2048).all() and (len(ids) > 2048 or len(own) == 1)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    laid = out.sort_values(["sequence_id", "offset"])
    assert (laid.groupby("sequence_id").length.sum() <= 2048).all()
    assert (laid.offset == laid.groupby("sequence_id").length.cumsum() - laid.length).all()
    assert out.sequence_id.nunique() <= 1.02 * np.ceil(out.length.sum() / 2048) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é's'llA1# \t\n 　<|endoftext|>")), max_size=40))
def test_cut_words_give_the_same_ids(text):
    ids = reference.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own_tokenizer().ids(text), "<u4").tolist() == ids


reference = reference_tokenizer()


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_constraint_holds(measure):
    rng = np.random.default_rng(1)
    length = np.sort(rng.integers(1, 200, 500))[::-1]
    demand = np.stack([length, np.ones_like(length), length**2], 1)
    limit = np.array([256, 4, 30000])
    demand = demand[(demand <= limit).all(1)]
    bins, offsets = packing.best_fit(demand, limit, np.array([1.0, 0.2, 0.3]), measure)
    for b in set(bins):
        assert (demand[bins == b].sum(0) <= limit).all()
        at = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][at] == np.concatenate([[0], np.cumsum(demand[bins == b][at, 0])[:-1]])).all()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "word " * 5000), (4, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, piece int")
    out = packing.op6(docs).toPandas()
    assert sorted(out[out.doc_id.isin([1, 2])].length) == [1, 1]
    assert len(out[out.doc_id == 4]) == 2 * len(set(out[out.doc_id == 4].piece))
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    assert packing.op6(docs.limit(0)).count() == 0


def plain_best_fit(demand, capacity, weights, measure):
    """Every open sequence tried for every piece, one at a time."""
    bins, out = [], []
    for d in demand.tolist():
        best = None
        for b, left in enumerate(bins):
            rest = [x - y for x, y in zip(left, d)]
            if min(rest) < 0:
                continue
            if measure == "norm":
                worth = sum(w * (r / c) ** 2 for w, r, c in zip(weights, rest, capacity))
            else:
                worth = -sum(w * x * y / c**2 for w, x, y, c in zip(weights, left, d, capacity))
            if best is None or (round(worth, 12), rest[0] if measure == "dot" else 0) < best[:2]:
                best = (round(worth, 12), rest[0] if measure == "dot" else 0, b)
        if best is None:
            bins.append(list(capacity))
            best = (0, 0, len(bins) - 1)
        bins[best[2]] = [x - y for x, y in zip(bins[best[2]], d)]
        out.append((best[2], best[0]))
    return out, bins


@pytest.mark.parametrize("measure", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(256, 3, 65536), (256, 256, 20000), (256, 5, 30000), (256, 256, 65536)])
def test_choice_of_sequence_equals_brute_force(measure, capacity):
    """As many sequences, each as full in every dimension, whichever of the three capacities binds."""
    rng = np.random.default_rng(7)
    length = np.sort(rng.integers(1, 140, 300))[::-1]
    demand = np.stack([length, np.ones_like(length), length**2], 1)
    limit, weights = np.array(capacity), np.array([1.0, 0.3, 0.2])
    bins, _ = packing.best_fit(demand, limit, weights, measure)
    _, want = plain_best_fit(demand, capacity, weights, measure)
    got = sorted(tuple(limit - demand[bins == b].sum(0)) for b in set(bins.tolist()))
    if measure == "norm":
        assert got == sorted(map(tuple, want))
    else:
        assert len(got) == len(want)


@pytest.mark.parametrize("limits", [{"max_documents": 3}, {"max_attention": 2048 * 300}, {"max_documents": 9, "max_attention": 2048 * 350}])
def test_limits_that_bind(spark, limits):
    """On whole texts, with capacities that tokens alone would pass, of documents or of attention."""
    import public_tokenizers as P

    from fieldglass.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2000")
    pieces = materialize(packing.cut(docs, 2048, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).drop("ids"), "pieces").where("length < 700")
    out = packing.pack(pieces, 2048, **limits).toPandas()
    by = out.groupby("sequence_id").length
    free = packing.pack(pieces, 2048).toPandas()
    assert len(out) == pieces.count() and by.count().max() <= limits.get("max_documents", 2048)
    assert by.apply(lambda x: (x**2).sum()).max() <= limits.get("max_attention", 2048**2)
    assert out.sequence_id.nunique() > free.sequence_id.nunique()


def test_equal_rows_are_dealt_to_all_groups(spark):
    from fieldglass.llm.common import materialize

    rows = spark.range(6000).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "100L length", "7L ids_crc32")
    out = packing.pack(materialize(rows, "pieces"), 2048, group_rows=1000).toPandas()
    sizes = (out.sequence_id // 2**32).value_counts()
    assert len(sizes) == 6 and sizes.max() < 1200 and (out.groupby("sequence_id").length.sum() <= 2048).all()
