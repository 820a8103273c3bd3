import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from fieldglass.llm import lines

SF = "/root/testdata/sf0.001"
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def by_hand(a, b):
    """Patience alignment written anew: equal ends, then the longest increasing chain of lines that are unique in both parts, then between its links.

    Of several longest chains, that which ends last, and before it, the last that can precede.
    """
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in by_hand(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return [*by_hand(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    met = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not met:
        return []
    length = []
    for n, (_, j) in enumerate(met):
        length.append(1 + max((length[m] for m in range(n) if met[m][1] < j), default=0))
    n = max(range(len(met)), key=lambda m: (length[m], m))
    chain = [n]
    while length[n] > 1:
        n = max(m for m in range(n) if length[m] == length[n] - 1 and met[m][1] < met[n][1])
        chain.insert(0, n)
    out, (i0, j0) = [], (0, 0)
    for i, j in [met[m] for m in chain] + [(len(a), len(b))]:
        out += [(i0 + x, j0 + y) for x, y in by_hand(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return sorted(out)


def gone_from(later, earlier, min_words=8):
    """Positions in later, a list of (position, line), of aligned blocks of so many words."""
    pairs = by_hand([x for _, x in later], [x for _, x in earlier])
    blocks = []
    for i, j in pairs:
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    return {later[i][0] for b in blocks if sum(len(re.findall(r"[^\x20\x09-\x0D]+", later[i][1])) for i, _ in b) >= min_words for i, _ in b}


def brute(rows, min_words=8):
    """Every document against every earlier one that has a line in common with it."""
    own = [(i, text, [(k, x) for k, x in enumerate((text or "").split("\n")) if HAS_WORD.search(x)]) for i, text in rows]
    sets = [{x for _, x in at} for _, _, at in own]
    out = []
    for (i, text, at), mine in zip(own, sets, strict=True):
        gone = set()
        for (e, _, other), theirs in zip(own, sets, strict=True):
            if i is not None and e is not None and e < i and not mine.isdisjoint(theirs):
                gone |= gone_from(at, other, min_words)
        kept = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)
        out.append((i, len((text or "").split("\n")), len(gone), ",".join(map(str, sorted(gone))) or None, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed, r.kept_sha256) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows_of(lines.op10(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in got) > 20


def test_crowds_and_edge_cases(spark):
    crowd = [(100 + i, f"own line {i} with words\nshared words one two three four five six seven\nand another {i % 3}") for i in range(40)]
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, crowd[0][1]), (4, "a b c d e f g h i\nx"), (4, "a b c d e f g h i\nx"), (5, "q\n\na b c d e f g h i\n\nx"), (6, "word " * 50000), (7, "word " * 50000), *crowd]
    docs = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, n_chars long, lines string")
    assert rows_of(lines.op10(docs)) == brute(rows)
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert 7 not in by and {1, 2, 3, None, 6} <= set(by) and by[5].text == "q\n\n" and by[5].n_chars == 3
    assert lines.op10(docs.limit(0)).count() == 0 and lines.dedup_lines(docs.limit(0)).count() == 0


@given(st.lists(st.sampled_from("abcdefg"), max_size=25), st.lists(st.sampled_from("abcdefg"), max_size=25))
def test_alignment_is_of_equal_lines_in_order(a, b):
    found = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert lines.patience(a, a) == [(i, i) for i in range(len(a))]


def test_alignment_finds_a_moved_insertion():
    rng = random.Random(3)
    a = [rng.random() for _ in range(50)]
    b = a[:20] + ["new"] * 3 + a[25:]
    assert lines.patience(b, a) == [(i, i) for i in range(20)] + [(i, i + 2) for i in range(23, 48)]


@given(st.lists(st.sampled_from("abcdefghij"), max_size=14), st.lists(st.sampled_from("abcdefghij"), max_size=14))
def test_alignment_is_that_by_hand(a, b):
    assert lines.patience(a, b) == by_hand(a, b)


def test_two_lines_that_only_later_documents_hold_together(spark):
    a, b = "line one with five words", "line two with five words"
    rows = [(1, a), (2, b), *((i, f"own line {i}\n{a}\n{b}") for i in range(3, 11))]
    got = {r.doc_id: r.n_removed for r in lines.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, **dict.fromkeys(range(4, 11), 2)}


def test_many_lines_and_hot_keys(spark):
    long = "\n".join(f"line {i} of a long text with some more words" for i in range(20000))
    rows = [(1, long), (2, long.replace("line 7 ", "line seven ")), *((i, f"own {i}\none line of at least eight words that all have\nend {i}") for i in range(3, 2500))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.op10(docs).collect()}
    assert got[1] == 0 and got[2] == 19999 and got[3] == 0 and all(got[i] == 1 for i in range(4, 2500))
