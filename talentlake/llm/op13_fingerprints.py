"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases, the phrases into phrases of phrases and so
on up to one root.  On each level runs of one symbol become one symbol, then
deterministic coin tossing colours the sequence: a symbol's colour is the lowest
bit in which it differs from its left neighbour, with that bit's value; repeated,
and with the colours 3 to 5 replaced by what the neighbours leave free, three
colours remain.  Phrases begin at the highest colours of their neighbourhood, so
they have 2 to 4 symbols, and where they begin depends only on a few symbols
around.  A phrase's name is a hash of its symbols' names: equal substrings have
equal names inside them, at any offset and in any document.

A fingerprint is the root's name and a MinHash sketch of the set of names from
level ``BASE`` up (phrases of about 18 bytes and more).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import as_texts, mix64, small_batches, written
from talentlake.llm.op02_line_dedup import text_stamp
from talentlake.llm.pieces import by_bytes

BASE = 3  # the lowest level whose names count
SLOTS = 128  # bytes of a sketch
ROOT = 8  # bytes of the root's name before it
BATCH_BYTES = 1 << 20

_OUTSIDE = 7  # the colour beyond a text's ends


# -- parsing -------------------------------------------------------------------------------


def _toss(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit in which two different symbols differ, plus the bit of ``x`` there."""
    low = x ^ left
    low &= -low if low.dtype.kind == "i" else ~low + low.dtype.type(1)
    place = np.bitwise_count(low - low.dtype.type(1)).astype(np.uint8)
    return 2 * place + ((x & low) != 0)


def _toss_table(size: int) -> np.ndarray:
    """``_toss`` for all pairs of symbols below ``size``: row left, column x."""
    x = np.arange(size, dtype=np.int64)
    table = _toss(np.tile(x, size), np.repeat(x, size))
    return table.astype(np.uint8)


_BYTES, _WIDE, _SMALL = _toss_table(256), _toss_table(128), _toss_table(16)


def _free_table() -> np.ndarray:
    """The smallest of three colours that neither neighbour has."""
    return np.array([[min({0, 1, 2} - {left, right}) for right in range(8)] for left in range(8)], np.uint8).ravel()


_FREE = _free_table()


def _again(colour: np.ndarray, starts: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """One more toss of colours below ``size``; before a text stands a symbol that differs in the lowest bit."""
    left = np.empty(len(colour), np.intp)
    left[1:] = colour[:-1]
    left[starts] = colour[starts] ^ 1
    return table[left * size + colour]


def three_colours(heads: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Colours 0 to 2, different between neighbours, of texts without equal neighbours that begin at ``starts``."""
    if heads.dtype == np.uint8:
        colour = _again(heads, starts, _BYTES, 256)
    else:
        left = np.empty_like(heads)
        left[1:] = heads[:-1]
        left[starts] = heads[starts] ^ heads.dtype.type(1)
        colour = _again(_toss(heads, left), starts, _WIDE, 128)
    colour = _again(_again(colour, starts, _SMALL, 16), starts, _SMALL, 16)
    ends = np.append(starts[1:], len(heads)) - 1
    for high in (5, 4, 3):
        at = np.flatnonzero(colour == high)
        left, right = colour[at - 1], colour[np.minimum(at + 1, len(heads) - 1)]
        left[np.isin(at, starts, assume_unique=True)] = _OUTSIDE
        right[np.isin(at, ends, assume_unique=True)] = _OUTSIDE
        colour[at] = _FREE[left.astype(np.intp) * 8 + right]
    return colour


def next_level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and where each text begins among them."""
    n = len(symbols)
    first = np.ones(n, bool)
    first[1:] = symbols[1:] != symbols[:-1]
    first[starts] = True
    at = np.flatnonzero(first)
    heads = symbols[at]
    length = np.diff(at, append=n)
    texts = np.searchsorted(at, starts)
    with np.errstate(over="ignore"):
        child = heads.astype(np.uint64)
        run = np.flatnonzero(length > 1)
        child[run] = mix64(child[run] + length[run].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        colour = three_colours(heads, texts)
        peak = np.zeros(len(at), bool)
        peak[1:] = colour[1:] > colour[:-1]
        peak[:-1] &= (colour[:-1] > colour[1:]) | np.isin(np.arange(1, len(at)), texts)
        # a text's first phrase has two symbols at least, so every level is shorter
        second = texts[texts + 1 < len(at)] + 1
        peak[second] = False
        peak[texts] = True
        begin = np.flatnonzero(peak)
        width = np.diff(begin, append=len(at))
        name = width.astype(np.uint64)
        for j in range(int(width.max(initial=0))):
            have = slice(None) if j == 0 else np.flatnonzero(width > j)
            mixed = (name[have] ^ child[begin[have] + j]) * np.uint64(0xC2B2AE3D27D4EB4F)
            name[have] = mixed ^ (mixed >> np.uint64(29))
        return mix64(name), np.searchsorted(begin, texts)


def phrases(texts: list[bytes]):
    """(level, names, text of each name) of every level from 1, of texts that are not empty; a text ends with its root."""
    own = np.flatnonzero([len(t) > 0 for t in texts])
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(texts[k]) for k in own], np.int64)
    level = 0
    while len(own):
        symbols, starts = next_level(symbols, np.cumsum(size) - size)
        size, level = np.diff(starts, append=len(symbols)), level + 1
        yield level, symbols, np.repeat(own, size)
        more = size > 1
        symbols, own, size = symbols[np.repeat(more, size)], own[more], size[more]


# -- sketches ------------------------------------------------------------------------------


def sketches(texts: list[bytes]) -> list[bytes]:
    """Root name and sketch of each text; an empty text has an empty fingerprint."""
    root, names, owners = np.zeros(len(texts), np.uint64), [], []
    last = np.zeros(len(texts), np.int64)
    for level, name, text in phrases(texts):
        n = np.bincount(text, minlength=len(texts))
        single = n[text] == 1
        root[text[single]], last[text[single]] = name[single], level
        keep = single if level < BASE else slice(None)
        names.append(name[keep])
        owners.append(text[keep])
    if not names:
        return [b""] * len(texts)
    name, text = np.concatenate(names), np.concatenate(owners)
    order = np.argsort(text, kind="stable")
    name, text = name[order], text[order]
    own, starts = np.unique(text, return_index=True)
    out = np.empty((len(own), SLOTS), np.uint8)
    with np.errstate(over="ignore"):
        k = np.arange(1, SLOTS + 1, dtype=np.uint64)
        flip, odd = mix64(k), mix64(k + np.uint64(1 << 32)) | np.uint64(1)
        for slot in range(SLOTS):
            low = np.minimum.reduceat((name ^ flip[slot]) * odd[slot], starts)
            out[:, slot] = mix64(low).astype(np.uint8)
    found = {t: root[t].tobytes() + out[i].tobytes() for i, t in enumerate(own.tolist())}
    return [found.get(t, b"") for t in range(len(texts))]


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common names, 0 to 1; 1 for equal fingerprints, 0 between empty and other ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = float(np.mean(np.frombuffer(a, np.uint8, SLOTS, ROOT) == np.frombuffer(b, np.uint8, SLOTS, ROOT)))
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))  # one byte agrees by chance once in 256


def _in_slices(texts: list[str]) -> list[bytes]:
    """Fingerprints, with about ``BATCH_BYTES`` of text in work at a time (or one longer text)."""
    raw = [t.encode() for t in texts]
    return [s for a, b in by_bytes([len(t) for t in raw], BATCH_BYTES) for s in sketches(raw[a:b])]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint (hexadecimal).

    Null text counts as empty; an empty text has the empty fingerprint.  Equal
    texts have equal fingerprints.  Null and repeated ids keep a row each; other
    columns are ignored; an empty table gives an empty result.  A text is parsed
    whole, in memory of some 30 bytes per byte of it.
    """
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            texts = as_texts(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(_in_slices(texts), pa.binary())], names=["doc_id", "n_chars", "f"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    signed = rows.mapInArrow(sign, "doc_id long, n_chars long, f binary")
    return signed.select("doc_id", "n_chars", F.lower(F.hex("f")).alias("fingerprint"))


# -- edited texts --------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The text with its last third (of code points, rounded down) replaced by the first as many of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_DONE, _HEAD, _TAIL = 0, 1, 2
_COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_WORK = f"kind int, part int, {_COLUMNS}, text string"
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_WORK_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *_RESULT, ("text", pa.string())])


def _compared(ids: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes]) -> list:
    """Result columns of texts with the texts that follow them."""
    new = [edited(t, f) for t, f in zip(texts, following)]
    new_prints = _in_slices(new)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).digest() for t in new], prints, new_prints,
        list(map(likeness, prints, new_prints)), list(map(likeness, prints, next_prints)),
    ]


def _edge(kind: int, part: int, row: tuple) -> pa.RecordBatch:
    doc_id, text, mark = row
    values = {"kind": kind, "part": part, "doc_id": doc_id, "fingerprint": mark, "text": text}
    return pa.record_batch([[values.get(f.name)] for f in _WORK_SCHEMA], schema=_WORK_SCHEMA)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows in descending id (ids of null
    last, equal ids by a hash of the text); after the last comes the first, so
    a table of one row follows itself.  Null text counts as empty.  Documents
    are range-partitioned by that order and compared with their neighbour inside
    the partition; a partition's last document, which needs the next
    partition's first, is finished by a join of these edges.  Other columns are
    ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def compare(batches):
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), as_texts(batch.column(1))
            for a, b in by_bytes([len(t) for t in all_texts], BATCH_BYTES):
                prints = _in_slices(all_texts[a:b])
                rows = list(zip(all_ids[a:b], all_texts[a:b], prints))
                if held is None:
                    yield _edge(_HEAD, part, rows[0])
                else:
                    rows.insert(0, held)
                held = rows.pop()
                if rows:
                    ids, texts, marks = map(list, zip(*rows))
                    _, after, next_marks = map(list, zip(*rows[1:], held))
                    n = [None] * len(ids)
                    yield pa.record_batch([[_DONE] * len(ids), [part] * len(ids), *_compared(ids, texts, marks, after, next_marks), n], schema=_WORK_SCHEMA)
        if held is not None:
            yield _edge(_TAIL, part, held)

    def finish(batches):
        for batch in batches:
            ids, texts, marks, after, next_marks = (c.to_pylist() for c in batch.columns)
            yield pa.record_batch(_compared(ids, texts, marks, after, next_marks), schema=_RESULT)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("stamp", text_stamp(F.col("text")))
    order = [F.desc_nulls_last("doc_id"), F.col("stamp")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    work = written(spread.mapInArrow(compare, _WORK), "edited")
    # As many rows as partitions: which one follows which.
    parts = work.where(F.col("kind") == _HEAD).select("part")
    follows = F.lead("part").over(Window.orderBy("part"))
    first = F.min("part").over(Window.partitionBy())
    chain = parts.select(F.col("part").alias("tail"), F.coalesce(follows, first).alias("head"))
    tails = work.where(F.col("kind") == _TAIL).select(F.col("part").alias("tail"), "doc_id", "text", "fingerprint")
    heads = work.where(F.col("kind") == _HEAD).select(F.col("part").alias("head"), F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    edges = tails.join(chain, "tail").join(heads, "head").select("doc_id", "text", "fingerprint", "after", "next_print")
    done = work.where(F.col("kind") == _DONE).select(*_RESULT.names).unionByName(edges.mapInArrow(finish, _COLUMNS))
    hexes = [F.lower(F.hex(c)).alias(c) if f.type == pa.binary() else F.col(c) for c, f in zip(_RESULT.names, _RESULT)]
    return done.select(*hexes)
