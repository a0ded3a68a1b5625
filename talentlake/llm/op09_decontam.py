"""Benchmark decontamination by latent semantic retrieval.

1. Documents become rows of term numbers over the benchmark's vocabulary.
2. Document frequencies over all passages give TF-IDF weights.
3. One distributed randomised SVD pass over the passages' TF-IDF matrix A sums
   A'(A G) for a Gaussian G; its orthogonal basis Q spans the latent space.
   Singular values come from the Nystrom form (A'A G)(G'A'A G)^-1(A'A G)'.
4. Every passage (overlapping runs of about an item's length) is a whitened
   latent vector; cosine with the items gives candidates.  Words of no item
   are dimensions orthogonal to all items: a passage with too small a share of
   its weight in the items' words is far from each and needs no vector.  The
   share is also taken on runs no longer than the scale's items, which an item
   that stands word for word fills alone, whatever stands around it.
5. A candidate counts when the longest common subsequence of words covers
   enough of the item, or a smaller share and the item's answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import as_texts, small_batches, written
from talentlake.llm.op02_line_dedup import text_stamp

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALES = (*range(1, 12), 16, 32, 64)  # passage lengths; an item is compared with its nearest
PASSAGE = 32  # words of the passages behind the weights and the latent space
ITEMS_A_BLOCK = 2_000  # items that go with the tasks at once; more make further rounds


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; ASCII characters but letters and digits separate them."""
    return text.lower().encode().translate(_TABLE).split()


def scale_of(length: int) -> int:
    return min(SCALES, key=lambda n: abs(np.log(n / length)))


def step_of(scale: int) -> int:
    """Words between the starts of two passages; short ones start at every word."""
    return 1 if scale < 16 else scale // 4


# Words of the runs whose share counts: no item of the scale is shorter, and some passage holds a
# run of every item that stands word for word.
RUNS = {n: min(next(k for k in range(1, n + 1) if scale_of(k) == n), n - step_of(n) + 1) for n in SCALES}


@dataclass(frozen=True)
class Settings:
    rank: int = 48            # latent dimensions
    cosine: float = 0.5       # candidates: latent cosine,
    share: float = 0.4        # and share of a passage's squared weight in words of the items
    covered: float = 0.75     # share of the item in the longest common subsequence
    with_answer: float = 0.55 # the same if the answer stands in the passage too
    answer_words: int = 5     # an item's last words stand for its answer if it has none of its own
    seed: int = 11


class Vocabulary:
    """Numbers of the words of all items and answers; the last stands for a word of no item."""

    def __init__(self, words: list[bytes]):
        self.rank = {w: k for k, w in enumerate(sorted(words))}
        self.none = len(self.rank)
        self.kind = np.dtype("<u2") if self.none < 1 << 16 else np.dtype("<u4")


class Items:
    """A block of benchmark items: term sequences and answers."""

    def __init__(self, rows: list[tuple[int | None, str | None, str | None]], vocab: Vocabulary, settings: Settings):
        seqs = [(i, words_of(t or ""), words_of(a or "")) for i, t, a in rows]
        seqs = [x for x in seqs if x[1]]
        rank = vocab.rank
        self.ids = [i for i, _, _ in seqs]
        self.seqs = [np.array([rank[w] for w in s], np.int64) for _, s, _ in seqs]
        self.answers = [
            np.array([rank[w] for w in a], np.int64) if a else s[-settings.answer_words :]
            for (_, _, a), s in zip(seqs, self.seqs)
        ]
        self.scale = [scale_of(len(s)) for s in self.seqs]


def _vocabulary(bench: DataFrame) -> Vocabulary:
    """Words of the whole benchmark (i, t, a); the driver gets each distinct word once."""

    def run(batches):
        for batch in batches:
            words: set[bytes] = set()
            for text, answer in zip(as_texts(batch.column(0)), as_texts(batch.column(1))):
                own = words_of(text)
                if own:
                    words.update(own, words_of(answer))
            yield pa.record_batch([pa.array(list(words), pa.binary())], names=["word"])

    return Vocabulary([bytes(r.word) for r in bench.select("t", "a").mapInArrow(run, "word binary").distinct().collect()])


def _blocks(bench: DataFrame):
    """Items (i, t, a) in lists of up to ``ITEMS_A_BLOCK``, read one partition at a time."""
    held = []
    for r in bench.toLocalIterator():
        held.append((r.i, r.t, r.a))
        if len(held) == ITEMS_A_BLOCK:
            yield held
            held = []
    if held:
        yield held


def _terms(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """doc_id, terms, stamp (of the text) and row, a key of the input row that holds once it is written."""
    rank, none, kind = vocab.rank, vocab.none, vocab.kind

    def run(batches):
        get = rank.get
        for batch in batches:
            out = []
            for text in as_texts(batch.column(1)):
                words = words_of(text)
                out.append(np.fromiter((get(w, none) for w in words), kind, len(words)).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "terms", "stamp"]
            )

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    rows = rows.withColumn("stamp", text_stamp(F.col("text"))).mapInArrow(run, "doc_id long, terms binary, stamp long")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _tiles(raw: bytes, kind: np.dtype, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a document and the passage (run of ``size`` words) of each."""
    t = np.frombuffer(raw, kind).astype(np.int64)
    return t, np.arange(len(t)) // size


def _sum_rows(rows: DataFrame, run, width: int) -> DataFrame:
    """Sum over all tasks of what ``run(batches)`` returns: an array of ``width`` bounded by the
    benchmark's vocabulary, dealt out by row before it is added up."""

    def emit(batches):
        total = run(batches)
        if total is not None:
            at = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch(
                [pa.array(at, pa.int64()), pa.array(total[at].tolist(), pa.list_(pa.float64()))], names=["term", "v"]
            )

    parts = rows.mapInArrow(emit, "term long, v array<double>")
    cols = [F.sum(F.col("v")[k]).alias(f"c{k}") for k in range(width)]
    return parts.groupBy("term").agg(*cols)


def _idf(terms: DataFrame, vocab: Vocabulary, size: int) -> np.ndarray:
    none, kind = vocab.none, vocab.kind

    def run(batches):
        df, n = np.zeros((none + 1, 1)), 0
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                t, tile = _tiles(raw, kind, size)
                if len(t):
                    pair = np.unique(tile * (none + 1) + t)
                    df[:, 0] += np.bincount(pair % (none + 1), minlength=none + 1)
                    n += int(tile[-1]) + 1
        df[none] = n  # passages
        return df

    sums = {r.term: r.c0 for r in _sum_rows(terms, run, 1).collect()}
    n = max(sums.get(none, 0.0), 1.0)
    df = np.array([sums.get(k, 0.0) for k in range(none)])
    return np.log((1 + n) / (1 + df)) + 0.1


def _latent(terms: DataFrame, vocab: Vocabulary, idf: np.ndarray, size: int, settings: Settings) -> np.ndarray:
    """Projection (term -> whitened latent vector) from one randomised pass over all passages."""
    none, kind, rank = vocab.none, vocab.kind, min(settings.rank, max(vocab.none, 1))
    gauss = np.random.default_rng(settings.seed).standard_normal((none, rank)).astype(np.float32)

    def run(batches):
        total = np.zeros((none, rank))
        weighted = gauss * idf[:, None].astype(np.float32)

        def add(seqs):
            t = np.concatenate([s[0] for s in seqs])
            step, tile = 0, []
            for s in seqs:
                tile.append(s[1] + step)
                step += int(s[1][-1]) + 1
            tile = np.concatenate(tile)
            known = t < none
            # cells (passage, term) with their counts: rows of the sparse TF matrix
            cell, count = np.unique(tile[known] * none + t[known], return_counts=True)
            if not len(cell):
                return
            row, term = cell // none, cell % none
            tf = (1 + np.log(count)).astype(np.float32)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            weight = tf * idf[term].astype(np.float32)
            length = np.sqrt(np.add.reduceat(weight**2, first))
            share = np.repeat(1 / np.maximum(length, 1e-9), np.diff(np.append(first, len(row)))).astype(np.float32)
            latent = np.add.reduceat(weighted[term] * (tf * share)[:, None], first, axis=0)
            per_cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
            for k in range(rank):
                total[:, k] += np.bincount(term, weights=latent[per_cell, k] * (weight * share), minlength=none)

        held, n = [], 0
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                s = _tiles(raw, kind, size)
                if len(s[0]):
                    held.append(s)
                    n += len(s[0])
                if n > 200_000:
                    add(held)
                    held, n = [], 0
        if held:
            add(held)
        return total

    y = np.zeros((none, rank))  # A'A G, at most vocabulary x rank
    for r in _sum_rows(terms, run, rank).collect():
        y[r.term] = [r[f"c{k}"] for k in range(rank)]
    q, _ = np.linalg.qr(y)
    core = gauss.T @ y
    core = (core + core.T) / 2 + np.eye(rank) * (1e-6 * max(np.trace(core) / rank, 1e-9))
    half = q.T @ y
    small = half @ np.linalg.pinv(core, hermitian=True) @ half.T  # A'A within the basis q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values = np.maximum(values, values.max() * 1e-3 if values.max() > 0 else 1.0)
    white = q @ vectors / np.sqrt(values)
    # directions of the terms, so that a passage is not the sum of its most frequent words alone
    white /= np.maximum(np.linalg.norm(white, axis=1, keepdims=True), 1e-12)
    return (white * idf[:, None]).astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _search(
    terms: DataFrame, items: Items, kind: np.dtype, idf: np.ndarray, projection: np.ndarray, settings: Settings
) -> DataFrame:
    """row, n_items, covered, known (the item has an id), item (its id times -1) and answer of every row with an item."""
    inside = np.append(idf**2, 0.0)
    weight = np.append(idf**2, np.median(idf) ** 2)  # a word of no item weighs like the items' median word
    table = np.vstack([projection, np.zeros((1, projection.shape[1]), np.float32)])
    scales = sorted(set(items.scale))
    groups = {n: [k for k, s in enumerate(items.scale) if s == n] for n in scales}

    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    targets = {n: unit(np.stack([table[items.seqs[k]].sum(axis=0) for k in ks])).T.astype(np.float32) for n, ks in groups.items()}
    sets = [np.unique(s) for s in items.seqs]

    def matches(t: np.ndarray) -> list[tuple[int, float, int]]:
        known = np.concatenate([[0.0], np.cumsum(inside[t])])
        if not known[-1]:
            return []
        total = np.concatenate([[0.0], np.cumsum(weight[t])])
        best: dict[int, tuple[float, int]] = {}
        for n in scales:
            step = step_of(n)
            begin = np.arange(0, max(len(t) - n + step, 1), step)
            end = np.minimum(begin + n, len(t))
            near = known[end] - known[begin] >= settings.share * (total[end] - total[begin])
            size = min(RUNS[n], len(t))
            dense = known[size:] - known[:-size] >= settings.share * (total[size:] - total[:-size])
            upto = np.concatenate([[0], np.cumsum(dense)])
            near |= upto[np.maximum(end - size + 1, begin)] > upto[begin]
            begin, end = begin[near], end[near]
            if not len(begin):
                continue
            edge = np.zeros(len(t) + 1, np.int64)  # vectors of the words of these passages only
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
            used = np.cumsum(edge[:-1]) > 0
            at = np.concatenate([[0], np.cumsum(used)])
            sums = np.zeros((at[-1] + 1, table.shape[1]))
            np.cumsum(table[t[used]], axis=0, out=sums[1:])
            for a in range(0, len(begin), 8192):
                x = unit((sums[at[end[a : a + 8192]]] - sums[at[begin[a : a + 8192]]]).astype(np.float32))
                p, q = np.nonzero(x @ targets[n] >= settings.cosine)
                for i, j in zip(p.tolist(), q.tolist()):
                    k = groups[n][j]
                    seq = items.seqs[k]
                    if k in best and best[k][0] >= 1:
                        continue
                    reach = step + max(0, len(seq) - n)  # the item may begin before or end after the passage
                    part = t[max(0, begin[a + i] - reach) : end[a + i] + reach]
                    if len(np.intersect1d(part, sets[k])) < settings.with_answer * 0.8 * len(sets[k]):
                        continue
                    covered = lcs(seq, part) / len(seq)
                    if covered > best.get(k, (0.0, 0))[0]:
                        answer = items.answers[k]
                        best[k] = (covered, int(lcs(answer, part) == len(answer)))
        return [
            (items.ids[k], c, a) for k, (c, a) in best.items()
            if c >= settings.covered or (a and c >= settings.with_answer)
        ]

    def run(batches):
        for batch in batches:
            out = []
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = matches(np.frombuffer(raw, kind).astype(np.int64))
                if found:
                    best = max((c, i is not None, -(i or 0), bool(a)) for i, c, a in found)
                    out.append((row, len(found), *best))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    names = ["row", "n_items", "covered", "known", "item", "answer"]
    return terms.select("row", "terms").mapInArrow(
        run, "row long, n_items long, covered double, known boolean, item long, answer boolean"
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    stamp: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_id (best covered), covered, answer;
    with ``stamp`` the stamp of the row's text too, which tells apart rows of one id or of none.

    Whole texts are searched; an item stands against all passages of about its
    length.  ``answer_col`` names the items' answers; without one the last
    words of an item are its answer.  Every benchmark row is an item: one with
    a null id contaminates and counts too, and item_id is null where it alone
    is best covered (of equally covered items the smallest id is given).
    Vocabulary, weights and latent space are the whole benchmark's; its
    distinct words pass through the driver.  Items go with the tasks in blocks
    of ``ITEMS_A_BLOCK``, whose size changes no result.  Null or empty texts
    and items match nothing; a null id stays null; repeated rows give repeated
    results (the same one); other columns are ignored; empty tables give no
    rows or no matches.
    """
    small_batches(docs.sparkSession)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    bench = benchmark.select(
        F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"), answer.alias("a")
    )
    vocab = _vocabulary(bench)
    terms = written(_terms(docs, vocab, id_col, text_col), "terms")
    found, more = None, ("stamp",) if stamp else ()
    if vocab.none:
        idf = _idf(terms, vocab, PASSAGE)
        projection = _latent(terms, vocab, idf, PASSAGE, settings)
        for rows in _blocks(bench):
            items = Items(rows, vocab, settings)
            if items.ids:
                part = written(_search(terms, items, vocab.kind, idf, projection, settings), "found")
                found = part if found is None else found.unionByName(part)
    if found is None:
        none = "false contaminated", "0L n_items", "cast(null as long) item_id", "0D covered", "false answer"
        return terms.selectExpr("doc_id", *none, *more)
    best = found.groupBy("row").agg(F.sum("n_items").alias("n"), F.max(F.struct("covered", "known", "item", "answer")).alias("b"))
    n = F.coalesce("n", F.lit(0))
    return terms.select("row", "doc_id", *more).join(best, "row", "left").select(
        "doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), F.when(F.col("b.known"), -F.col("b.item")).alias("item_id"),
        F.coalesce("b.covered", F.lit(0.0)).alias("covered"), F.coalesce("b.answer", F.lit(False)).alias("answer"),
        *more,
    )
