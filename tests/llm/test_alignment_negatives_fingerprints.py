"""Alignment, hard negatives and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from talentlake.llm import op11_alignment, op12_hard_negatives, op13_fingerprints, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", " a  b ", "<|endoftext|> a<s>b</s>", "don't  stop", "\t a b\n", "日本 語 123 4 5a6", "½ ² a", "x▁y", "▁",
    "é É <0x41>", "a\x85b c", "a\x00b", "😀 ok", "word " * 3000, "x" * 3000, "one\ntwo\n\nthree", "a", "don't  stop", "ªº×÷ÿ 12ab",
]


# -- alignment ----------------------------------------------------------------------------------


def _tokens(text):
    """(id, bytes) of both tokenizers by the libraries, or two empty lists."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    if not hasattr(_tokens, "made"):
        tok = Tokenizer.from_file(PATHS[0])
        tok.encode_special_tokens = True
        # bytes that print stand for themselves, the others for the alphabet's remaining characters in order
        alphabet = ByteLevel.alphabet()
        own = [b for b in range(256) if chr(b) in alphabet]
        rest = sorted((c for c in alphabet if ord(c) > 255), key=ord)
        table = {chr(b): b for b in own} | dict(zip(rest, [b for b in range(256) if b not in own]))
        _tokens.made = tok, table, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    tok, table, model = _tokens.made
    if not text:
        return [], []
    a = [(i, bytes(table[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want else ([], [])


def _spans(tokens):
    end, out = 0, []
    for i, raw in tokens:
        out.append((i, end, end + len(raw)))
        end += len(raw)
    return out


def _brute_alignment(texts):
    links, rows, counts = [], [], Counter()
    for text in texts:
        a, b = map(_spans, _tokens(text))
        own, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            own += [(i, j) for j, s2, e2 in b[first : first + e - s + 1] if s2 < e and s < e2]
        counts.update(own)
        links.append(own)
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, begin = [], 0
        for e in common:
            side = lambda t: ",".join(str(i) for i, s, e2 in t if begin <= s and e2 <= e)  # noqa: B023, E731
            groups.append(f"{side(a)}|{side(b)}")
            begin = e
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (n_a, n_b, n_groups, n_links, sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), sha)
        for (n_a, n_b, n_groups, n_links, sha), own in zip(rows, links)
    ]


def test_gallop_is_the_binary_rank():
    rnd = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 500), (500, 1), (70, 3000), (3000, 70), (64, 64), (129, 5000)):
        ends = np.unique(rnd.integers(1, 10_000, m))
        drive = np.unique(np.append(rnd.integers(1, ends[-1] + 1, n), ends[-1]))
        assert (op11_alignment.gallop(drive, ends) == np.searchsorted(ends, drive)).all()


@pytest.mark.parametrize("chunk_links", [4_000_000, 40])
def test_alignment_as_brute_force(docs_of, corpus, monkeypatch, chunk_links):
    monkeypatch.setattr(op11_alignment, "CHUNK_LINKS", chunk_links)
    texts = ODD + [r[1] for r in corpus if not r[1] or len(r[1]) < 1500]
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(texts))]
    got = op11_alignment.align(docs_of(list(zip(ids, texts))), *PATHS, batch_bytes=3000)
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i, *row) for i, row in zip(ids, _brute_alignment(texts))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want, key=key)
    assert op11_alignment.align(docs_of([]), *PATHS).count() == 0


# -- hard negatives -----------------------------------------------------------------------------


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 shard", "2 block", "'x' q", "3 part", "4 score")


def _run(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, op12_hard_negatives.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 100 == 0, label=label).select(*cols).collect()))


def _sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    con.execute(f"CREATE TABLE out AS {queries.ORACLES['op12_hard_negatives']}")
    return sorted(con.execute("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM out").fetchall())


@pytest.mark.parametrize(("shard", "block"), [(2048, 2048), (40, 2)])
def test_hard_negatives_as_sql(spark, monkeypatch, shard, block):
    monkeypatch.setattr(op12_hard_negatives, "SHARD_ROWS", shard)
    monkeypatch.setattr(op12_hard_negatives, "BLOCK_ANCHORS", block)
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k * 5, [x + rnd.gauss(0, 0.2) for x in rnd.choice(base)], rnd.randrange(3)) for k in range(300)]
    rows += [(2000 + k, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], k % 3) for k in range(101)]  # equal vectors: ties by id
    rows += [(3000, None, 1), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3002, [float("nan")] * 6, 2), (3003, [float("inf")] * 6, 2), (3100, [0.0] * 6, 0), (3101, [1.0] * 6, None)]
    got = _run(spark, rows)
    assert got == _sql(rows) and len(got) > 100


def test_hard_negatives_edges(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, [1.0], 0)]) == []  # no anchor
    assert _run(spark, [(100, [1.0], 0)]) == []  # nothing to compare with
    rows = [(100, [1.0, 2.0], 0), (101, [1.0], 0), (102, [1.0, 0.0, 5.0], 1), (102, [1.0, 0.0, 5.0], 1), (None, [1.0], 1)]
    assert _run(spark, rows) == [(100, 101, 1, 102, 65536, 65536)]  # zeros follow short vectors, a repeated row counts once
    big = [(100, [2.0**40], 0), (101, [2.0**38], 0), (102, [2.0**38], 1), (103, [2.0**38 * 0.7], 1)]
    assert [r[:4] for r in _run(spark, big)] == [(100, 101, 1, 102)]  # products beyond a long


def test_threshold_stops_early():
    """Sorted access ends once the threshold is strictly below the kth score, with all ties met."""
    rows = np.zeros((1000, 2))
    rows[:, 0] = np.arange(1000)
    lists = op12_hard_negatives.SortedLists(np.arange(1000), rows)
    met, scores, depth = lists.search(np.array([2.0, 0.0]), lambda m, s, t: t < op12_hard_negatives.kth_score(s, 3))
    assert depth == op12_hard_negatives.FIRST_DEPTH and len(met) < 100 and sorted(scores)[-3:] == [1994, 1996, 1998]


# -- fingerprints -------------------------------------------------------------------------------


def _names(text):
    """Phrase names of the levels that count, by text, without numpy across texts."""
    return {(level, int(n)) for level, names, _ in op13_fingerprints.phrases([text.encode()]) if level >= 3 for n in names}


def test_fingerprints_as_brute_force(docs_of, corpus):
    rows = [r[:2] for r in corpus] + [(60, corpus[3][1]), (None, "no id"), (None, None), (7, "again 7")]
    docs = docs_of(rows)
    got = op13_fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    stamp = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') text").withColumn("h", op13_fingerprints.text_stamp(F.col("text"))).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), stamp[r[1]]))
    mark = {t: op13_fingerprints.sketches([t.encode()])[0] for _, t in order}
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        new_mark = op13_fingerprints.sketches([new.encode()])[0]
        like = op13_fingerprints.likeness
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), mark[text].hex(), new_mark.hex(), like(mark[text], new_mark), like(mark[text], mark[after])))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert op13_fingerprints.edited_likeness(docs_of([])).count() == 0
    one = op13_fingerprints.edited_likeness(docs_of([(1, "abcdef")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    prints = {r.doc_id: r for r in op13_fingerprints.fingerprints(docs_of(rows)).where("doc_id < 7").collect()}
    assert all(prints[i].fingerprint == mark[t].hex() for i, t in order if i is not None and i < 7)


def test_equal_substrings_share_names_at_any_offset():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(1, 9)))
    shared = " ".join(word() for _ in range(400))
    texts = [" ".join(word() for _ in range(n)) + "x" * n + shared + " ".join(word() for _ in range(40)) for n in (0, 3, 50)]
    inside = _names(shared)
    for text in texts:
        assert len(inside & _names(text)) > 0.9 * len(inside)
    others = _names(" ".join(word() for _ in range(400)))
    assert len(inside & others) < 0.02 * len(inside)


def test_levels_shrink_and_colours_differ():
    rnd = np.random.default_rng(5)
    for symbols in (rnd.integers(0, 4, 5000).astype(np.uint8), rnd.integers(0, 2**63, 5000).astype(np.uint64), np.zeros(3000, np.uint8)):
        starts = np.array([0, 1, 3, 700, 2000])
        names, after = op13_fingerprints.next_level(symbols, starts)
        before_sizes, sizes = np.diff(starts, append=len(symbols)), np.diff(after, append=len(names))
        assert ((sizes < before_sizes) | (before_sizes == 1)).all() and (sizes > 0).all()
    heads = np.array([1, 2, 1, 2, 9, 8, 255, 0, 7, 3, 5, 6], np.uint8)
    colour = op13_fingerprints.three_colours(heads, np.array([0, 5]))
    assert colour.max() < 3 and (np.diff(colour.astype(int))[[0, 1, 2, 3, 5, 6, 7, 8, 9, 10]] != 0).all()


def test_likeness_follows_the_shared_part():
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa")) + str(rnd.randrange(999)) for _ in range(n))
    a = text(600)
    near = [op13_fingerprints.likeness(*op13_fingerprints.sketches([a.encode(), (a[: int(len(a) * s)] + text(600)[: int(len(a) * (1 - s))]).encode()])) for s in (1, 0.9, 2 / 3, 1 / 3, 0)]
    assert near[0] == 1 and near == sorted(near, reverse=True)
    assert abs(near[1] - 0.9 / 1.1) < 0.15 and abs(near[2] - 0.5) < 0.15 and near[4] < 0.05
