import random

from fieldglass.llm import lines
from tests.llm.test_lines import SF, brute, rows_of

P = "a passage of eight words that many hold"


def test_registered_query_aligns_with_every_earlier_document(spark):
    from fieldglass.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(queries.op10_line_alignment(spark, SF)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_first_holder_that_cannot_be_aligned(spark):
    rows = [(1, f"{P}\nx\n{P}\nz"), *((i, f"own {i}\n{P}\nown too {i}") for i in range(2, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(lines.op10(docs))
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 27


def test_random_documents_match_all_pairs(spark):
    rng = random.Random(5)
    pool = [P, "six words are in this one", "two words", "x", "one two three four five six seven eight nine", "a b c d"]
    rows = []
    for _ in range(300):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice([f"own {rng.randrange(400)} line", "", " "]) for _ in range(rng.randrange(1, 12)))
        rows.append((rng.choice([None, *range(200)]), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_rows(rows)
    for rare in (1, 6):
        got = lines.removed_lines(docs, 8, rare)
        assert sorted((r["__id"], tuple(r["__removed"])) for r in got.collect()) == want
    assert lines.op10(docs.limit(0)).count() == 0


def brute_rows(rows):
    """Ids and removed positions of each text once, as removed_lines has them."""
    out = brute(list(dict.fromkeys(rows)))
    return sorted((i, tuple(map(int, gone.split(",")))) for i, _, n, gone, _ in out if n)


def test_long_lines_that_an_earlier_document_has_go(spark):
    """Recall: of lines of 8 words or more that an earlier document has, how many go. Alignment keeps those out of order."""
    import re

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    gone = {r.doc_id: set(map(int, r.removed.split(","))) for r in lines.op10(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.removed}
    seen, found, all_ = {}, 0, 0
    for i in sorted(rows):
        for k, x in enumerate(rows[i].split("\n")):
            if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 8:
                if x in seen and seen[x] < i:
                    all_, found = all_ + 1, found + (k in gone.get(i, ()))
                seen.setdefault(x, i)
    print(found, all_)
    assert all_ > 100 and found >= 0.9 * all_
