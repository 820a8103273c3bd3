import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from fieldglass.llm import alignment
from fieldglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, pair string, stretch int"
FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    """Ids and bytes of each token of a text, one at a time, from the tokenizers' own files."""
    import sentencepiece

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    of = alignment.byte_level_bytes()
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[3])

    def piece(p):
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return (lambda t: [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, piece(b.id_to_piece(i))) for i in b.encode(t)])


def brute(rows, encoders):
    """Tokens' byte ranges, compared one by one."""
    docs = []
    for doc_id, text in rows:
        a, b = ([], []) if not text else (encoders[0](text), encoders[1](text))
        want = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links, first = [], 0
        for i, x0, x1 in spans[0]:
            while first < len(spans[1]) and spans[1][first][2] <= x0:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < x1:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for d in docs for x in d[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return sorted((repr(i), na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, na, nb, ng, links, sha in docs)


def result(df):
    return sorted((repr(r["doc_id"]), *(r[c] for c in COLUMNS[1:])) for r in df.collect())


ODD = [
    (1, "plain words, twice"), (2, "plain words, twice"), (2, "plain words, twice"), (3, None), (4, ""), (None, "ünïcödé \U0001f600 中文"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, "▁ a piece's own space"), (7, " two  spaces\t\n\r\n end "), (8, "a"), (9, " "), (10, "\x00\x01"), (11, "ﬁ ligature é"), (12, "x" * 500), (13, "word " * 3000 + "end"), (14, "don't stop 12345 ...!!"),
]


def test_brute_force_on_documents(spark, encoders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = result(QUERIES["op12_tokenizer_alignment"](spark, SF))
    want = brute(rows, encoders)
    assert len(got) == len(want) == len(rows) and got == want


@pytest.mark.parametrize("rows,size", [(1000, 4 << 20), (1, 1), (3, 60)])
def test_odd_texts_in_stretches_of_any_size(spark, encoders, rows, size):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], DDL).repartition(2)
    assert result(alignment.align(docs, *FILES, rows=rows, size=size)) == brute(ODD, encoders)


def test_bytes_that_differ_have_no_tokens(encoders):
    """A piece's own space sign in a text comes back as a space."""
    a, b = alignment.vocabularies(*FILES)
    row = alignment.aligned(pa.array([6, 8]), ["▁ x", "a"], a, b, "s").to_pylist()[0]
    assert row["n_a"] == [0, 1] and row["n_links"] == [0, 1] and row["groups_sha256"][0] == "" and row["held"][0] == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], DDL)
    df = alignment.op12(docs)
    assert df.collect() == [] and df.columns == COLUMNS


def test_texts_without_tokens_alone(spark, encoders):
    rows = [(1, None), (2, ""), (None, None)]
    assert result(alignment.op12(spark.createDataFrame([(*r, "x", 1) for r in rows], DDL))) == brute(rows, encoders)


def test_ids_equal_the_tokenizer_file(spark, encoders):
    encode, table = alignment.byte_bpe(*FILES[:3])
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text] + [t for _, t in ODD if t]
    for text in texts:
        assert [(i, table[i]) for i in encode(text).tolist()] == encoders[0](text)
