"""Alignment of two tokenizers' tokens by galloping intersection of their byte ends.

Both tokenizers cut the same bytes, so a token is known by the byte offset
where it ends.  The shorter list of ends drives an exponential-plus-binary
search into the longer one; ends common to both cut the text into groups, and
the difference of two successive ranks is the range of tokens that a driving
token overlaps (its links).

Link counts of id pairs over the whole corpus are summed in two steps.  A task
numbers the distinct pairs of a run of documents (a chunk) and keeps per
document only sorted pair numbers and multiplicities; the chunk's pairs, not
the documents' links, are shuffled, summed, joined with their sums and sent back
to the chunk.  A chunk has at most about ``CHUNK_PAIRS`` pairs and
``CHUNK_LINKS`` links (or one document), so no group grows with the corpus, and
a pair that stands in every document is one row per chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import as_texts, shared_path, small_batches
from talentlake.llm.pieces import BYTE_CHARS, by_bytes

CHUNK_PAIRS = 200_000
CHUNK_LINKS = 4_000_000
STRIDE = 64  # every so many ends are searched from the list's start, the others from the last of these

_PLAIN = re.compile("[\t\n\r -~À-ÿ]*")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of texts by a byte-level tokenizers file, special strings being plain text.

    Where the file's merges stand in the order of their ids, plain texts
    (printable ASCII, Latin-1 letters, usual white space) are encoded by tiktoken
    from the same vocabulary; all others by the tokenizers library.
    """

    _made: dict[str, ByteTokens] = {}

    @classmethod
    def at(cls, path: str) -> ByteTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
        entries = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.bytes = [bytes(map(byte_of.__getitem__, e)) if byte_of.keys() >= set(e) else e.encode() for e in entries]
        self.fast = self._ranked(spec)

    def _ranked(self, spec: dict):
        """A tiktoken encoding of the same ids, or None where the file is no plain byte-level BPE."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), model.get("merges", [])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        ids = [vocab.get("".join(m), -1) for m in pairs]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or ids != sorted(set(ids)) or -1 in ids or any(c not in vocab or vocab[c] > ids[0] for c in BYTE_CHARS):
            return None
        import tiktoken

        special = {t["id"] for t in spec.get("added_tokens") or []}
        ranks = {self.bytes[i]: i for i in vocab.values() if i not in special}
        return tiktoken.Encoding("byte-level", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def doubtful(self, texts: list[str]) -> list[int]:
        """Texts that the bytes of their ids may not give back: byte-level merges of plain texts always do."""
        return [k for k, t in enumerate(texts) if self.fast is None or not _PLAIN.fullmatch(t)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Native 32-bit integers."""
        out: list = [None] * len(texts)
        for k, text in enumerate(texts):
            if self.fast is not None and _PLAIN.fullmatch(text):
                out[k] = array("I", self.fast.encode_ordinary(text)).tobytes()
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, e in zip(rest, self.tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                out[k] = array("I", e.ids).tobytes()
        return out


class PieceTokens:
    """Ids of texts by a sentencepiece model that puts a space before them, run of spaces by run of spaces.

    Where no piece has a space after another character, pieces never reach over
    the start of a run of spaces, so the ids of a text are those of its runs
    (spaces and what follows them) one after the other.  New runs of a batch
    are encoded in one call.
    """

    _made: dict[str, PieceTokens] = {}
    _RUNS = re.compile(" +[^ ]*")
    LONGEST, LIMIT, ENTRY = 48, 40 << 20, 260  # of runs kept: characters, bytes in all, bytes besides a run's own

    @classmethod
    def at(cls, path: str) -> PieceTokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes = [self._raw(i, p) for i, p in enumerate(pieces)]
        self.space = [self.model.piece_to_id("▁")]
        # each plain character alone, doubled and between others comes back as it is
        plain = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
        tests = ["".join(x) for c in plain for x in ((c,), (c, c), ("a", c, "b"), ("a ", c), (c, " ", c))]
        self.keeps = all(b"".join(map(self.bytes.__getitem__, ids)) == b" " + t.encode() for t, ids in zip(tests, self._encode(tests)))
        self.memo: dict[str, bytes] = {}  # ids as native 32-bit integers
        self.size = 0

    def _raw(self, i: int, piece: str) -> bytes:
        return bytes([int(_BYTE_PIECE.fullmatch(piece)[1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def doubtful(self, texts: list[str]) -> list[int]:
        """Texts that the bytes of their ids may not give back: where the model keeps all plain characters, those with others."""
        return [k for k, t in enumerate(texts) if not self.keeps or not _PLAIN.fullmatch(t)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Native 32-bit integers of the ids of texts that begin with a space, which the model adds itself."""
        if not self.splits:
            return [array("I", ids).tobytes() for ids in self._encode([t[1:] for t in texts])]
        runs = [self._RUNS.findall(t) if len(t) > 1 else [] for t in texts]
        memo = self.memo
        if self.size > self.LIMIT:
            memo.clear()
            self.size = 0
        new = list(set(chain.from_iterable(runs)).difference(memo))
        # the model puts the first of a run's spaces before what it encodes
        for run, ids in zip(new, self._encode([r[1:] for r in new])):
            memo[run] = array("I", ids if len(run) > 1 else self.space).tobytes()
        out = [b"".join(map(memo.__getitem__, r)) for r in runs]
        for run in new:
            if len(run) > self.LONGEST:
                del memo[run]
            else:
                self.size += len(run) + len(memo[run]) + self.ENTRY
        return out


# -- galloping ---------------------------------------------------------------------------


def _search(values: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of the first of ``ends`` that is not below each value, known to be ``start`` or later:
    steps that double until one end is high enough, then halving between the last two."""
    low, high, top = start.copy(), start.copy(), len(ends) - 1
    lanes, step = np.flatnonzero(ends[high] < values), 1
    while len(lanes):
        low[lanes] = high[lanes] + 1
        high[lanes] = np.minimum(high[lanes] + step, top)
        lanes, step = lanes[ends[high[lanes]] < values[lanes]], 2 * step
    lanes = np.flatnonzero(low < high)
    while len(lanes):
        middle = (low[lanes] + high[lanes]) >> 1
        below = ends[middle] < values[lanes]
        low[lanes[below]] = middle[below] + 1
        high[lanes[~below]] = middle[~below]
        lanes = lanes[low[lanes] < high[lanes]]
    return low


def gallop(drive: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of the first of ``ends`` not below each of ``drive``; both ascend, and the last end is the highest of all."""
    heads = drive[::STRIDE]
    first = _search(heads, np.zeros(len(heads), np.int64), ends)
    return _search(drive, np.repeat(first, STRIDE)[: len(drive)], ends)


class Alignment:
    """Common ends and links of two lists of ends over the same bytes."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        by_a = len(ends_a) <= len(ends_b)
        drive, ends = (ends_a, ends_b) if by_a else (ends_b, ends_a)
        rank = gallop(drive, ends) if len(drive) else np.zeros(0, np.int64)
        common = ends[rank] == drive if len(drive) else np.zeros(0, bool)
        other = np.zeros(len(ends), bool)
        other[rank[common]] = True
        self.common_a, self.common_b = (common, other) if by_a else (other, common)
        # the driving token k overlaps the other list's tokens first[k] .. rank[k]
        first = np.concatenate([[0], (rank + common)[:-1]]) if len(rank) else rank
        n = rank - first + 1
        before = np.cumsum(n) - n
        mine = np.repeat(np.arange(len(n)), n)
        theirs = np.arange(len(mine)) - np.repeat(before - first, n)
        self.link_a, self.link_b = (mine, theirs) if by_a else (theirs, mine)


def group_order(common_a: np.ndarray, common_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B tokens where each group's A tokens stand before its B tokens."""
    group_a = np.cumsum(common_a) - common_a
    group_b = np.cumsum(common_b) - common_b
    n_a, n_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    b_before, a_through = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    return np.arange(len(group_a)) + b_before[group_a], np.arange(len(group_b)) + a_through[group_b]


# -- documents of a batch ------------------------------------------------------------------


class _Pair:
    """Both tokenizers and their tables by id."""

    _made: dict[tuple[str, str], _Pair] = {}

    @classmethod
    def at(cls, path_a: str, path_b: str) -> _Pair:
        key = (path_a, path_b)
        if key not in cls._made:
            cls._made[key] = cls(path_a, path_b)
        return cls._made[key]

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens.at(path_a), PieceTokens.at(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # printed ids with what follows: first all that end no side of a group, then all that do
        table = lambda values: np.array([*values, None], object)[:-1]
        self.print_a = table(b"%d%s" % (i, s) for s in (b",", b"|") for i in range(len(self.len_a)))
        self.print_b = table(b"%d%s" % (i, s) for s in (b",", b";") for i in range(len(self.len_b)))

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of all texts in one array, and their number in each text; texts of which either's
        bytes are not a space and the text have none."""
        spaced = [" " + t for t in texts]
        ok, out = np.array([len(t) > 0 for t in texts], bool), []
        for side, got in ((self.a, self.a.ids(spaced)), (self.b, self.b.ids(spaced))):
            raw = side.bytes.__getitem__
            for k in side.doubtful(spaced):
                ok[k] &= b"".join(map(raw, np.frombuffer(got[k], np.uint32).tolist())) == spaced[k].encode()
            out.append((np.frombuffer(b"".join(got), np.uint32).astype(np.int64), np.array([len(x) // 4 for x in got], np.int64)))
        return [(ids if ok.all() else ids[np.repeat(ok, n)], n * ok) for ids, n in out]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align_texts(pair: _Pair, texts: list[str]):
    """Per text n_a, n_b, n_groups, n_links and the digest of its groups; and the links: text number, A id, B id."""
    (ids_a, n_a), (ids_b, n_b) = pair.tokens(texts)
    # texts follow each other in one run of bytes, whose cuts between texts are common ends
    at = Alignment(np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b]))
    place_a, place_b = group_order(at.common_a, at.common_b)
    printed = np.empty(len(ids_a) + len(ids_b), object)
    printed[place_a] = pair.print_a[ids_a + at.common_a * len(pair.len_a)]
    printed[place_b] = pair.print_b[ids_b + at.common_b * len(pair.len_b)]
    ends = np.cumsum(n_a + n_b)
    printed = printed.tolist()
    digests = [hashlib.sha256(b"".join(printed[e - n : e])[:-1]).digest() if n else None for e, n in zip(ends.tolist(), (n_a + n_b).tolist())]
    text_of = np.repeat(np.arange(len(texts)), n_a)[at.link_a]
    n_links = np.bincount(text_of, minlength=len(texts))
    return n_a, n_b, _sums(at.common_a, n_a), n_links, digests, text_of, ids_a[at.link_a], ids_b[at.link_b]


def _planes(values: np.ndarray) -> bytes:
    """32-bit integers with all first bytes before all second ones and so on, for the compressor."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class _Chunk:
    """Numbers of the distinct pairs of a run of documents, and how many links have them."""

    def __init__(self):
        self.name, self.number, self.n, self.links = uuid.uuid4().int >> 65, {}, np.zeros(1024, np.int64), 0

    def add(self, codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Numbers of distinct codes, each met ``times`` more."""
        number = self.number
        out = np.fromiter((number.setdefault(c, len(number)) for c in codes.tolist()), np.int64, len(codes))
        while len(self.n) < len(number):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        self.n[out] += times
        self.links += int(times.sum())
        return out

    def full(self) -> bool:
        return len(self.number) >= CHUNK_PAIRS or self.links >= CHUNK_LINKS

    def pairs(self) -> tuple[bytes, bytes]:
        codes = np.fromiter(self.number, np.int64, len(self.number))
        return codes.astype("<i8").tobytes(), self.n[: len(codes)].astype("<i8").tobytes()


_MARKED = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("digest", pa.binary()), ("pair", pa.binary()), ("times", pa.binary()), ("codes", pa.binary()), ("code_n", pa.binary()),
])
_MARKED_DDL = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest binary, pair binary, times binary, codes binary, code_n binary"


def _marked(ids: pa.Array, chunk: _Chunk, found) -> pa.RecordBatch:
    """One row per text: its counts, digest, sorted pair numbers (as differences) and their multiplicities."""
    n_a, n_b, n_groups, n_links, digests, text_of, a, b = found
    distinct, code = np.unique((a << 32) | b, return_inverse=True)
    number = chunk.add(distinct, np.bincount(code, minlength=len(distinct)))
    key, times = np.unique((text_of << 32) | number[code], return_counts=True)
    own, pair = key >> 32, key & 0xFFFFFFFF
    step = np.diff(pair, prepend=0)
    cut = np.searchsorted(own, np.arange(len(n_a) + 1))
    step[cut[:-1][cut[:-1] < cut[1:]]] = pair[cut[:-1][cut[:-1] < cut[1:]]]
    pairs = [_planes(step[x:y]) for x, y in zip(cut, cut[1:])]
    often = [_planes(times[x:y]) for x, y in zip(cut, cut[1:])]
    none = [None] * len(n_a)
    return pa.record_batch([[chunk.name] * len(n_a), ids, n_a, n_b, n_groups, n_links, digests, pairs, often, none, none], schema=_MARKED)


def _end_of(chunk: _Chunk) -> pa.RecordBatch:
    codes, n = chunk.pairs()
    row = {"chunk": chunk.name, "codes": codes, "code_n": n}
    return pa.record_batch([[row.get(f.name)] for f in _MARKED], schema=_MARKED)


def _marks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, batch_bytes: int) -> DataFrame:
    def mark(batches):
        pair, chunk = _Pair.at(path_a, path_b), _Chunk()
        for batch in batches:
            ids, texts = batch.column(0), as_texts(batch.column(1))
            for x, y in by_bytes([len(t) for t in texts], batch_bytes):
                yield _marked(ids.slice(x, y - x), chunk, align_texts(pair, texts[x:y]))
                if chunk.full():
                    yield _end_of(chunk)
                    chunk = _Chunk()
        if chunk.number:
            yield _end_of(chunk)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(mark, _MARKED_DDL)


def _pairs(ends: DataFrame) -> DataFrame:
    """chunk, k, a, b, n: the chunks' distinct pairs."""

    def unpack(batches):
        for batch in batches:
            for name, codes, n in zip(*(c.to_pylist() for c in batch.columns)):
                code, n = np.frombuffer(codes, "<i8"), np.frombuffer(n, "<i8")
                for x in range(0, len(code), 50_000):
                    c = code[x : x + 50_000]
                    yield pa.record_batch(
                        [[name] * len(c), np.arange(x, x + len(c), dtype=np.int32), (c >> 32).astype(np.int32), (c & 0xFFFFFFFF).astype(np.int32), n[x : x + len(c)]],
                        names=["chunk", "k", "a", "b", "n"],
                    )

    return ends.select("chunk", "codes", "code_n").mapInArrow(unpack, "chunk long, k int, a int, b int, n long")


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 18,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a``: a byte-level tokenizers file, which encodes a space and the
    text; ``path_b``: a sentencepiece model that puts a space before the text.
    Special strings inside texts are plain text.  Null or empty texts, and
    texts that either tokenizer's bytes do not give back, have no tokens:
    zeros and an empty digest.  Rows are known by their place, so null and
    repeated ids keep a row each; other columns are ignored; an empty table
    gives an empty result.  A text is aligned whole, in memory in proportion
    to its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = shared_path(spark, "aligned")
    _marks(docs, path_a, path_b, id_col, text_col, batch_bytes).write.option("compression", "zstd").parquet(path)
    marks = spark.read.schema(_MARKED_DDL).parquet(path)
    pairs_path, sums_path = f"{path}-pairs", f"{path}-sums"
    _pairs(marks.where("codes is not null")).write.parquet(pairs_path)
    pairs = spark.read.schema("chunk long, k int, a int, b int, n long").parquet(pairs_path)
    pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).write.parquet(sums_path)
    sums = spark.read.schema("a int, b int, n long").parquet(sums_path)
    highest = sums.groupBy("b").agg(F.max("n").alias("highest"))
    counted = sums.join(highest, "b").select("a", "b", F.col("n").alias("total"), (F.col("n") == F.col("highest")).alias("best"))
    valued = pairs.drop("n").join(counted, ["a", "b"]).select("chunk", "k", "total", "best")

    def value(rows: pa.Table, known: pa.Table) -> pa.Table:
        total, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        k = known["k"].to_numpy()
        total[k], best[k] = known["total"].to_numpy(), known["best"].to_numpy()
        n_best, count_sum = [], []
        for step, times in zip(rows["pair"].to_pylist(), rows["times"].to_pylist()):
            pair, often = np.cumsum(_from_planes(step), dtype=np.int64), _from_planes(times).astype(np.int64)
            n_best.append(int((best[pair] * often).sum()))
            count_sum.append(int((total[pair] * often).sum()))
        out = rows.drop_columns(["chunk", "pair", "times"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    own = marks.where("codes is null").drop("codes", "code_n")
    done = own.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(
        value, "doc_id long, n_a long, n_b long, n_groups long, n_links long, digest binary, n_best long, count_sum long"
    )
    return done.withColumn("groups_sha256", F.coalesce(F.lower(F.hex("digest")), F.lit(""))).drop("digest")

