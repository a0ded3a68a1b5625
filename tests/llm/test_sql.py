"""Operators with SQL, against DuckDB on a small corpus with odd rows."""

import pytest
from pyspark.sql import functions as F

from talentlake.llm import op02_line_dedup, op07_quality, op08_substring, op10_near_dup, queries



def sha():
    return F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")


def lines(docs):
    out = op02_line_dedup.apply_bitmaps(docs, op02_line_dedup.keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", sha())


def quality(docs):
    rows = op07_quality.ledger(docs)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *measures, (~op07_quality.passes("base")).alias("base_failed"), op07_quality.passes().alias("kept"), "fail_bits")


def substrings(docs):
    return op08_substring.cut_spans(docs, op08_substring.repeated_spans(docs)).select("doc_id", "n_words", "n_removed", sha())


def near(docs):
    return op10_near_dup.near_duplicates(docs, size=4)


CASES = [("op2_line_dedup", lines), ("op7_quality_rules", quality), ("op8_substring_dedup", substrings), ("op10_near_duplicates", near)]


@pytest.mark.parametrize(("name", "run"), CASES)
def test_same_as_sql(docs_of, tables, corpus, name, run):
    docs = docs_of(corpus)
    got = run(docs)
    rows, cols = tables(docs, queries.ORACLES[name])
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(rows)


@pytest.mark.parametrize(("name", "run"), CASES)
def test_empty_null_and_repeated(docs_of, name, run):
    assert run(docs_of([])).count() == 0
    rows = run(docs_of([(None, None), (None, "a b"), (1, "x " * 40), (1, "x " * 40), (2, None)])).collect()
    assert len(rows) == 5
    same = [r for r in rows if r.doc_id == 1]
    assert same[0] == same[1]


def test_keep_bitmap_runs(docs_of):
    line = "this very common line has more than forty characters in it"
    text = f"{line}\n{line}\na\n{line}"
    runs = {r.doc_id: [(x.first, x.last) for x in r.dropped_runs] for r in op02_line_dedup.keep_bitmaps(docs_of([(i, text) for i in range(6)])).collect()}
    assert runs == {i: [(0, 1), (3, 3)] for i in range(5)}


def test_ablations(docs_of, corpus):
    rows = op07_quality.ledger(docs_of(corpus))
    bits = [r.fail_bits for r in rows.collect()]
    for r in op07_quality.ablations(rows).collect():
        bit = 1 << op07_quality.RULES[r.rule]
        assert (r.n_failed, r.n_failed_alone, r.n_rejected, r.n_docs) == (
            sum(bool(b & bit) for b in bits), bits.count(bit), sum(b != 0 for b in bits), len(bits)
        )


def test_residual_pairs_are_complete(docs_of, spark, corpus):
    """With all links of the stars withheld, the prefix join alone finds every near pair."""
    docs = docs_of(corpus).where("text is not null and length(text) > 30")
    texts = docs.select(F.col("doc_id").alias("node"), "text").dropDuplicates(["text"])
    mixed = texts.select("node", F.col("node").alias("comp"))
    pairs = op10_near_dup.residual_pairs(mixed, texts, 4, 80)
    found = {tuple(r) for r in op10_near_dup.verified(pairs, texts, 4, 80).collect()}
    words = op10_near_dup.WordHash()
    sets = {r.node: set(op10_near_dup.shingle_set(r.text.encode(), words, 4).tolist()) for r in texts.collect()}
    want = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert found == want and want


def test_texts_that_share_an_id(docs_of):
    """Each text of a repeated id has its own links: no copy is lost, no clean text marked."""
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(5, a), (5, b), (3, a + " end"), (7, b + " end"), (5, c), (8, c + " end"), (2, text("d"))]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near(docs_of(order)).collect())
        assert got == sorted([
            (5, 37, 3, False), (5, 37, 5, True), (3, 38, 3, True), (7, 38, 5, False), (5, 37, 5, True), (8, 38, 5, False), (2, 37, 2, True)
        ])
