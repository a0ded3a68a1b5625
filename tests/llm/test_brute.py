"""Operators without SQL, against brute force, exact round trips or planted cases."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentlake.llm import op01_license, op03_mixing, op04_token_counts, op05_secrets, op06_token_files, op09_decontam
from talentlake.llm.pieces import PieceEncoder

ODD = [
    None, "", " ", "  ", "a", "<|endoftext|> a", "a <|endoftext|>b c", "don't  stop", "'red can't--'s x", "áb é  x", "ΑΣ ΣΑ", "İx y",
    "\t a b\n", "a \n b", "日本 語 123 4 5a6", "½ ² a", "<|startoftext|>x y<|endoftext|>", "\x1c a b\x1dc d", "é É", "a\x85b c",
    "Å x", "word " * 5000, "x" * 30000, "one\ntwo\n\nthree",
]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_license_places(docs_of):
    texts = [
        None, "", "Under THE MIT-License, the mit license.", "apache license version 2 cc by nc", "x " * 127 + "the mit license",
        "y " * 255 + "the mit license " + "z " * 300 + "cc by nc", "mit the license", "the mit", "z " * 383 + "cc by nc the mit license",
        op01_license.LICENSES[0].text.upper(), " ".join(op01_license.LICENSES[0].text.split()[5:]),
    ]
    got = {r.doc_id: r for r in op01_license.license_scan(docs_of(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        w = words(text)
        places, labels = [], set()
        for t in op01_license.PHRASES:
            p = words(t.text)
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {t.label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""}
        # every template that some block holds at its threshold is found
        blocks = [set(w[b : b + 256]) for b in range(0, max(len(w), 1), 128)]
        for t in op01_license.LICENSES:
            s = set(words(t.text))
            if any(len(s & b) >= (1.0 if len(s) < op01_license.SHORT else t.threshold) * len(s) for b in blocks):
                assert t.label in r.labels
    assert got[9].labels == got[10].labels == "mit" and got[9].score == 1.0
    assert op01_license.license_scan(docs_of([])).count() == 0


def test_license_base_phrases(docs_of):
    """The contract's phrases, written out: places of "the mit license" without "under" are no base places."""
    texts = [
        "See the MIT license.", "Under the mit-license; UNDER THE MIT LICENSE", "the mit license, under the mit license", "under mit license",
        "apache license version 2.0 CC-BY-NC 4.0", "under the mit", "x " * 127 + "under the mit license",
    ]
    got = [tuple(r)[1:6] for r in op01_license.license_scan(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == [
        (4, 0, None, None, ""), (8, 2, 0, 4, "mit"), (7, 1, 3, 3, "mit"), (3, 0, None, None, ""),
        (10, 2, 0, 5, "apache-2,cc-by-nc"), (3, 0, None, None, ""), (131, 1, 127, 127, "mit"),
    ]


def test_short_and_long_templates(docs_of):
    """Common words of a short template are not enough; a template of any length lies whole in some block."""
    texts = [
        "This file is released under the terms of the GNU General Public License.",
        "the software is under review and will be released once the license is bought", "Released under the MIT License.",
    ]
    got = {r.doc_id: r.labels for r in op01_license.license_scan(docs_of(list(enumerate(texts)))).collect()}
    assert "mit" not in got[0] + got[1] and got[2] == "mit"
    long = " ".join(f"word{k}" for k in range(700))
    own = (op01_license.Template("own", long, 0.9),)
    shifted = [(k, "x " * n + long + " y" * n) for k, n in enumerate((0, 300, 650, 699, 700, 1399))] + [(9, long[: len(long) // 2])]
    got = {r.doc_id: r.labels for r in op01_license.license_scan(docs_of(shifted), licenses=own).collect()}
    assert got == {**dict.fromkeys(range(6), "own"), 9: ""}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_the_library_s(docs_of, name):
    path = public_tokenizers.path(name)
    rows = [(i if i else None, t) for i, t in enumerate(ODD)]
    got = sorted(map(tuple, op04_token_counts.token_counts(docs_of(rows), path).collect()), key=lambda r: r[0] or 0)
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == [(i, len((t or "").encode()), len(w), len(w) > 512) for (i, t), w in zip(rows, want)]
    raw = PieceEncoder(path).id_bytes([t or "" for t in ODD])
    assert [np.frombuffer(x, PieceEncoder.at(path).id_type).tolist() for x in raw] == want
    assert op04_token_counts.token_counts(docs_of([]), path).count() == 0


def test_sentencepiece_counts(docs_of):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["hello world", "", "日本"]
    got = {r.doc_id: r.n_tokens for r in op04_token_counts.token_counts(docs_of(list(enumerate(texts))), path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_mph_round_trip():
    rnd = np.random.default_rng(3)
    key = rnd.choice(np.arange(-50_000, 50_000), 20_000, replace=False)
    copy = rnd.integers(0, 3, 20_000)
    reader = op06_token_files.MphReader(op06_token_files.build_mph(key, copy, key % 7 + 7, key + 60_000, copy + 1))
    slot = reader.slots(key, copy)
    assert sorted(slot.tolist()) == list(range(20_000))  # minimal and perfect
    assert (reader.offset[slot] == key + 60_000).all() and (reader.length[slot] == copy + 1).all()
    assert (reader.slots(key + 200_000, copy) >= 0).mean() < 0.001  # the fingerprint refuses other keys
    assert len(op06_token_files.MphReader(op06_token_files.build_mph(*[np.zeros(0, np.int64)] * 5)).slots(key, copy)) == 20_000


def test_token_files(spark, docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(6, ODD[2]), (None, "no id here"), (None, "nor here")]
    docs = docs_of(rows)
    root = op06_token_files.write_corpus(docs, path, 2)
    got = sorted(map(tuple, op06_token_files.corpus_rows(docs, root).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    text, start = dict(rows[: len(ODD)]), 0
    for doc_id, begin, n, crc in got:
        assert begin == start
        start += n
        if doc_id is not None:
            ids = [*tok.encode(text[doc_id] or "", add_special_tokens=False).ids, 2]
            assert (n, crc) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert op06_token_files.open_key(spark, root, 9).tolist() == [*tok.encode(ODD[3], add_special_tokens=False).ids, 2]
    assert op06_token_files.open_key(spark, root, 10) is None
    empty = docs_of([])
    assert op06_token_files.corpus_rows(empty, op06_token_files.write_corpus(empty, path, 2)).count() == 0


def test_each_index_file_is_read_once(spark, docs_of, monkeypatch):
    """Keys of a bucket meet in one task: with many buckets, as many file reads as buckets, and long words are not kept."""
    monkeypatch.setattr(op06_token_files, "KEYS_A_BUCKET", 40)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = docs_of([(i, f"text number {i}") for i in range(600)])
    root = op06_token_files.write_corpus(docs.repartition(7), path, 2)
    keys = docs.selectExpr("doc_id", "0L copy").repartition(9)
    n_buckets = spark.read.parquet(f"{root}/index_files").count()
    found = op06_token_files.lookup(keys, root).withColumn("task", F.spark_partition_id()).withColumn("bucket", op06_token_files._bucket(n_buckets))
    assert n_buckets == 15 and found.select("bucket", "task").distinct().count() == n_buckets and found.count() == 600
    assert op06_token_files.corpus_rows(docs, root).count() == 600
    encoder = PieceEncoder(path)
    encoder.id_bytes(["x" * 500 + " short"])
    assert list(encoder._word_bytes) == ["short"]


def test_source_targets():
    t = op03_mixing.source_targets({"b": 100, "a": 1000, None: 1000, "c": 100})
    # weights a 3, b 1, c 2, null 3 share 3300; b and c stop at 200, the rest goes on by weight
    assert t["b"] == t["c"] == 200 and t["a"] == t[None] == pytest.approx(1450)
    assert op03_mixing.source_targets({}) == {}
    assert op03_mixing.source_targets({"a": 0, "b": 10}) == {"a": 0.0, "b": pytest.approx(15)}


def test_mix_meets_targets(docs_of):
    rnd = np.random.default_rng(1)
    rows = [(i, "w " * int(rnd.integers(1, 400)), [None, "a", "b", "c"][i % 4 if i % 3 else 0]) for i in range(600)]
    rows += [(700, None, "a"), (701, "", None), (5, rows[5][1], rows[5][2]), (None, "x y z", "a")]
    docs = docs_of(rows)
    mixed = op03_mixing.mix(docs)
    got = op03_mixing.mix_rows(mixed).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in got:
        assert r.taken <= 2 * r.size
        s = sizes.setdefault(r.source, [0, r.target, 0, r.source_size])
        s[0] += r.taken
        s[2] += r.size
    want = op03_mixing.source_targets({k: v[2] for k, v in sizes.items()})
    for source, (taken, target, size, source_size) in sizes.items():
        assert target == pytest.approx(want[source]) and size == source_size
        assert abs(taken - target) <= 0.01 * target + 20
    again = op03_mixing.mix_rows(op03_mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = op03_mixing.mixed_documents(docs, mixed)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert op03_mixing.mix(docs_of([])).count() == 0


def test_mix_of_rows_without_an_id(docs_of):
    """Thousands of rows of one size without an id, equal ones among them, are rounded one by one and meet the targets."""
    rows = [(None, "w " * 3 + f"x{k}", "a") for k in range(700)] + [(None, "y " * 4, "a")] * 300
    rows += [(k, "w " * 6, "b") for k in range(40)] + [(7, "z " * 5, None)] * 31
    docs = docs_of(rows)
    mixed = op03_mixing.mix(docs)
    got = op03_mixing.mix_rows(mixed).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in ("a", "b", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    copies = op03_mixing.mixed_documents(docs, mixed)
    taken = {r.source: r.n for r in copies.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    assert copies.columns == docs.columns
    assert taken == {s: sum(r.taken for r in got if r.source == s) for s in taken} and copies.count() == sum(r.copies for r in got)


def test_secrets(docs_of):
    rnd = np.random.default_rng(2)
    hexes = ["".join(rnd.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    rows = [(i, f'the text of it token = "{h}" and more') for i, h in enumerate(hexes)]
    rows += [(100 + i, f"call the number {10**15 + i * 7919} now and then") for i in range(60)]
    rows += [(200, None), (201, ""), (None, "password=0123456789abcdef77"), (202, "no candidates here")]
    got = op05_secrets.scan_secrets(docs_of(rows)).collect()
    assert {r.doc_id for r in got} == {*range(60), *range(100, 160), None}
    right = [r.is_secret == (r.doc_id is None or r.doc_id < 100) for r in got]
    assert np.mean(right) > 0.95
    assert op05_secrets.scan_secrets(docs_of([])).count() == 0
    one = op05_secrets.scan_secrets(docs_of([(1, "password=0123456789abcdef77")])).collect()  # one label only: nothing is removed
    assert [(r.score, r.is_secret) for r in one] == [(1.0, True)]


def test_long_secrets_are_whole(docs_of):
    """Runs over 200 characters are one candidate each, with the whole run's hash, wherever their digit stands."""
    rnd = np.random.default_rng(6)
    key = lambda n: "".join(rnd.choice(list("abcdefABCDEF0123456789+/"), n))
    first = "7" + key(199)
    runs = [key(200) + "1", key(4999) + "2", first + "x", first + "y", "a" * 300 + "5" + "b" * 20, "k" * 4000 + "9", "9" + "z" * 100_000]
    rows = [(i, f'token = "{r}" and more') for i, r in enumerate(runs)] + [(50, "n" * 500 + " none")]
    got = {r.doc_id: (r.length, r.sha256) for r in op05_secrets.scan_secrets(docs_of(rows)).collect()}
    assert got == {i: (len(r), hashlib.sha256(r.encode()).hexdigest()) for i, r in enumerate(runs)}


def test_secret_features_as_brute_force(docs_of):
    """Every feature of every candidate by plain Python; words inside camel case count for the coverage."""
    import math

    known = ["user", "name", "from", "request", "number", "parser", "html", "order", "names"]
    texts = [f"the {w} of {w} stands here" for w in known for _ in range(3)]
    found = [
        "getUserNameFromRequest12", "HTMLParserNumber99x", "usernames_order_7aB", "0123456789abcdef0123", "https://host.example/path/to/order123456789/x",
        'token = "aB3dE5gH7jK9mN1pQ3"', "password=zzzzqqqqxxxx1111", "9" * 20, "x" * 50 + "1",
    ]
    rows = list(enumerate(texts + [f"see {f} there 12 now" for f in found]))
    words = op05_secrets.dictionary(docs_of(rows))
    table = {r.entry: r.n for r in words.collect()}
    assert set(known) <= set(table)
    pairs = {}
    for w, n in table.items():
        for x, y in zip(w, w[1:]):
            pairs[x + y] = pairs.get(x + y, 0) + n
    letters = "abcdefghijklmnopqrstuvwxyz"
    log_p = {x + y: math.log((pairs.get(x + y, 0) + 1) / sum(pairs.get(x + z, 0) + 1 for z in letters)) for x in letters for y in letters}
    got = op05_secrets.features(op05_secrets.candidates(docs_of(rows)), words).collect()
    assert len(got) >= len(found)
    for r in got:
        c, low = r.candidate, r.candidate.lower()
        covered = set()
        for m in re.finditer(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", c):
            piece = m[0].lower()
            for b in range(len(piece)):
                for e in range(b + 4, min(len(piece), b + 12) + 1):
                    if piece[b:e] in table:
                        covered |= set(range(m.start() + b, m.start() + e))
        steps = [log_p[x + y] for x, y in zip(low, low[1:]) if x + y in log_p]
        count = lambda pattern, text=c: len(re.findall(pattern, text)) / len(c)
        want = {
            "length": len(c), "digit_share": count("[0-9]"), "upper_share": count("[A-Z]"), "hex_share": count("[0-9a-f]"),
            "distinct_share": len(set(c)) / len(c), "transitions": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
            "case_changes": count("(?<=[a-z])(?=[A-Z])"), "likelihood": sum(steps) / len(steps) if steps else math.log(1 / 26), "coverage": len(covered) / len(c),
            "is_path": bool(re.search(r"://|\.[a-z]{2,4}/|/[^/]+/", r.around) or re.search("/[a-z]+/", c)),
            "has_assignment": bool(re.search(r"^[\"']?[A-Za-z_]{2,20}[=:]", r.around)), "quoted": bool(re.search("[\"']", r.around)),
            "key_before": bool(re.search(op05_secrets.KEY_WORDS, f"{r.before2} {r.before}")), "number_before": False, "number_after": False, "long_before": False,
        }
        assert {k: pytest.approx(float(v), abs=1e-8) for k, v in want.items()} == {k: r[k] for k in want}, c
    by = {r.candidate: r for r in got}
    assert by["getUserNameFromRequest12"].coverage == pytest.approx(19 / 24) and by["HTMLParserNumber99x"].coverage == pytest.approx(16 / 19)


def test_held_out_formats(docs_of):
    """A forest that has not seen a format judges most of its findings right by the other features."""
    rnd = np.random.default_rng(9)
    key = lambda n: "".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n)) + "7"
    rows = []
    for i in range(80):
        rows += [f"ghp_{key(35)} is here", f'set api_key = "{key(30)}" now', f"password={key(24)} done", f"call {rnd.integers(10**17, 10**18)} now",
                 f"see https://host.example/order/number/request-from-user-{i}x/ there", "the order number of the request from the user host example"]
    docs = docs_of(list(enumerate(rows)))
    labelled = op05_secrets.weak_labels(op05_secrets.features(op05_secrets.candidates(docs), op05_secrets.dictionary(docs)))
    got = {r.format: (r.label, r.n_right / r.n) for r in op05_secrets.held_out_formats(labelled).collect()}
    assert set(got) >= {"provider", "quoted", "assigned", "number"}
    assert all(share > 0.9 for kind, (label, share) in got.items() if label == 1.0)


def test_forest_on_held_out_findings(docs_of):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(300):
        rows.append((2 * i, 'set api_key = "' + "".join(rnd.choice(list("0123456789abcdef"), 32)) + '" here'))
        rows.append((2 * i + 1, f"order number {rnd.integers(10**15, 10**16)} was sent"))
    found = op05_secrets.features(op05_secrets.candidates(docs_of(rows)), op05_secrets.dictionary(docs_of(rows)))
    labelled = found.withColumn("label", (F.col("doc_id") % 2 == 0).cast("double"))
    model = op05_secrets.fit_forest(labelled.where("doc_id < 300"))
    held = model.transform(labelled.where("doc_id >= 300")).selectExpr("avg(cast(prediction = label as double))").first()[0]
    assert held > 0.95


def test_forest_sample_holds_rare_labels(docs_of):
    """A few positives among many negatives are all drawn, so the forest is fitted and finds them."""
    rnd = np.random.default_rng(31)
    key = lambda: "".join(rnd.choice(list("0123456789abcdef"), 32))
    rows = [(i, f'set api_key = "{key()}" here') for i in range(4)]
    rows += [(10 + i, f"order number {rnd.integers(10**15, 10**16)} was sent") for i in range(400)]
    found = op05_secrets.features(op05_secrets.candidates(docs_of(rows)), op05_secrets.dictionary(docs_of(rows)))
    labelled = found.withColumn("label", (F.col("doc_id") < 10).cast("double"))
    model = op05_secrets.fit_forest(labelled, rows=8)
    assert model is not None
    assert model.transform(labelled.where("doc_id < 10")).where("prediction = 1").count() == 4


def test_lcs():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        a, b = rnd.integers(0, 5, rnd.integers(1, 12)), rnd.integers(0, 5, rnd.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert op09_decontam.lcs(a, b) == table[-1, -1]


def test_decontamination(spark, docs_of):
    rnd = np.random.default_rng(9)
    vocab = np.array([f"v{i}" for i in range(3000)])
    text = lambda n: " ".join(rnd.choice(vocab, n))
    items = [(i, text(int(rnd.integers(14, 70)))) for i in range(40)] + [(98, ""), (99, None), (None, "a b")]
    rows, leaked = [], set()
    for i in range(200):
        if i % 4 == 0:
            item = items[i % 40][1].split()
            if i % 8 == 0:  # a paraphrase: some words changed
                for k in range(0, len(item), 9):
                    item[k] = "changed"
            rows.append((i, text(int(rnd.integers(0, 300))) + "\n" + " ".join(item).upper() + ". " + text(50)))
            leaked.add(i)
        else:
            rows.append((i, text(int(rnd.integers(0, 400)))))
    rows += [(300, None), (301, ""), (0, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op09_decontam.decontaminate(docs_of(rows), bench).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.contaminated} == leaked
    assert all(r.item_id == r.doc_id % 40 for r in got if r.contaminated)
    assert op09_decontam.decontaminate(docs_of([]), bench).count() == 0
    assert not any(r.contaminated for r in op09_decontam.decontaminate(docs_of(rows[:9]), bench.limit(0)).collect())


def test_decontamination_of_short_items(spark, docs_of):
    """Items of 3 to 10 words word for word in foreign text, and of common words among rare ones."""
    rnd = np.random.default_rng(10)
    foreign = lambda n: " ".join(f"f{k}" for k in rnd.integers(0, 5000, n))
    items = [(i, " ".join(f"v{k}" for k in rnd.choice(600, 3 + i % 8, replace=False))) for i in range(48)]
    items += [(48 + i, " ".join(f"c{k}" for k in rnd.choice(60, n, replace=False))) for i, n in enumerate((12, 14, 24, 46))]
    rows = [(i, f"{foreign(int(rnd.integers(0, 90)))} {t} {foreign(int(rnd.integers(0, 90)))}") for i, t in items]
    rows += [(100 + i, " ".join(f"{foreign(30)} {w}" for w in t.split())) for i, t in items]  # its words, far apart
    rows += [(200 + i, " ".join(f"{foreign(6)} c{k}" for k in range(60))) for i in range(40)]  # the c words are common
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in op09_decontam.decontaminate(docs_of(rows), bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {i for i, _ in items}
    assert all(got[i].item_id == i and got[i].covered == 1 for i, _ in items)


def test_decontamination_in_blocks(spark, docs_of, monkeypatch):
    """The block size changes no row: repeated rows, rows and items without an id, answers and ties."""
    rnd = np.random.default_rng(12)
    text = lambda n: " ".join(f"v{k}" for k in rnd.integers(0, 900, n))
    texts = [text(int(rnd.integers(5, 60))) for _ in range(23)]
    items = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(77, texts[1]), (None, texts[2])]
    rows = [(i, f"{text(40)} {t} {text(25)} {texts[(i + 7) % 23] if i % 3 else ''}") for i, t in enumerate(texts)]
    rows += [(100 + i, text(200)) for i in range(10)] + [rows[4]] * 3 + [(None, t) for _, t in rows[:6]] * 2 + [(None, text(90))]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), docs_of(rows)
    run = lambda: sorted(map(str, op09_decontam.decontaminate(docs, bench).collect()))
    whole = run()
    got = op09_decontam.decontaminate(docs, bench).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 13
    assert sum(r.contaminated for r in got) == 23 + 3 + 12 and {r.doc_id for r in got if not r.contaminated} == {*range(100, 110), None}
    best = {r.doc_id: r for r in got}
    assert best[1].item_id == 1 and best[1].n_items == 3  # twice in the benchmark, and its neighbour
    assert best[0].item_id is None and best[0].covered == 1 and best[0].n_items == 1  # an item without an id
    monkeypatch.setattr(op09_decontam, "ITEMS_A_BLOCK", 4)
    assert run() == whole


def test_pipeline(spark, docs_of, corpus, tmp_path):
    """The stages by hand on a small folder: quality, one of each group, no leak, mix, files."""
    import corpus_pipeline

    docs_of(corpus).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    leak = corpus[1][1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        states.append(stage(spark, states[-1], str(tmp_path)))
        assert states[-1].columns == list(corpus_pipeline.COLUMNS)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    assert {52, 53, 54, 55, 56} & ids[1] == set() and {0, 1, 2, 30} <= ids[1]
    assert {30, *range(31, 40)} & ids[2] == {30} and {3, 50, 51} & ids[2] == {3}
    assert ids[2] - ids[3] == {1}
    taken = op03_mixing.mix_rows(op03_mixing.mix(states[3])).collect()
    assert states[4].count() == sum(r.copies for r in taken)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == states[4].count() and {r.doc_id for r in out} == ids[4]


def test_pipeline_rows_without_or_with_one_id(spark, docs_of, tmp_path):
    """Null and repeated ids through every stage: each text is decided on its own, one row of a group stays."""
    import corpus_pipeline

    rnd = np.random.default_rng(14)
    text = lambda n=60: " ".join(f"w{k}" for k in rnd.integers(0, 3000, n))
    leak, a, b, c, d, e, f = text(20), text(), text(), text(), text(), text(), text()
    rows = [(None, f"{text(30)} {leak} {text(30)}"), (None, a), (None, a), (None, a + " end"), (None, b), (1, b + " end")]
    rows += [(2, c), (2, c), (2, d), (3, d + " end"), (2, f"{text(30)} {leak}"), (4, e), (None, f), (2, "too short"), (None, None)]
    docs_of(rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    states = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        state = stage(spark, state, str(tmp_path))
        states.append([(r.doc_id, r.text) for r in state.collect()])
    assert sorted(states[0], key=str) == sorted(rows[:-2], key=str)
    one_a = [r for r in states[1] if r in rows[1:4]]
    assert len(one_a) == 1 and sorted([r for r in states[1] if r not in one_a], key=str) == sorted(
        [rows[0], (1, b + " end"), (2, c), (2, d), rows[10], (4, e), (None, f)], key=str
    )
    assert sorted(states[2], key=str) == sorted([r for r in states[1] if r not in (rows[0], rows[10])], key=str)
    mixed = corpus_pipeline.mix(spark, state, str(tmp_path))
    kept = [(r.doc_id, r.text) for r in mixed.collect()]
    assert set(kept) <= set(states[2])
    files = corpus_pipeline.token_files(spark, mixed, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in files), key=str) == sorted((k for k, _ in kept), key=str)
