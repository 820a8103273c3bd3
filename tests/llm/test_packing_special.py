import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldglass.llm import packing

FILE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
MARK = "<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([MARK, *"ab é'sl1# \t\n　<|>", "endoftext"]), max_size=30).map("".join))
def test_ids_are_those_of_the_file_at_its_defaults(text):
    own = packing.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == FILE.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_the_added_token(spark):
    rows = [(1, f"one {MARK} two"), (2, MARK), (3, f"a{MARK}{MARK} b\n"), (4, "plain words")]
    out = {r.doc_id: r for r in packing.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        ids = [*FILE.encode(text, add_special_tokens=False).ids, 0]
        assert (out[i].length, out[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
