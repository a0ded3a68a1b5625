"""Substring de-duplication with fixed-block anchors.

A window is ``WINDOW`` consecutive words.  With blocks of ``BLOCK`` words at
multiples of ``BLOCK`` and WINDOW >= 2 * BLOCK - 1, every window holds at least
one whole block of its own document, and wherever the window's words stand
again, a rolling run of BLOCK words equals that block.  So:

1. index the non-overlapping blocks and probe them with every rolling run; a
   block whose run occurs twice or more anywhere is hit (hashes may only add hits);
2. extend: the windows around hit blocks are compared by 96-bit hashes; those that
   occur twice or more are repeats, and neighbouring ones join into maximal spans.

Hashes travel packed, dealt by value into parts of bounded size, and are
combined per map batch, so a run that is everywhere arrives at most twice from
each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import WordHash, as_bytes, small_batches, window_hashes

WINDOW, BLOCK = 35, 18
FLUSH = 1_500_000  # windows a map task holds before it deals them out

_BLOCK_TYPE = np.dtype([("h", "<u4"), ("b", "<u4"), ("doc", "<i8"), ("stamp", "<i8")])
_OWNER_TYPE = np.dtype([("doc", "<i8"), ("stamp", "<i8"), ("n", "<u4")])


def n_parts(df: DataFrame, n: int | None) -> int:
    """Parts that hashes are dealt into: four per shuffle partition, so they scale with the session."""
    return n or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null id: 0), stamp (of id and text; equal rows share one) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc, text).alias("stamp"), text.alias("text"))


def _id():
    """The id of a keyed row: the stamp of a null id is that of the text alone."""
    return F.when((F.col("doc") != 0) | (F.col("stamp") != F.xxhash64("text")), F.col("doc")).alias("doc_id")


def _deal(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash: its upper bits, scaled."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _packed(ascending: np.ndarray) -> bytes:
    """Sorted 32-bit hashes as differences, byte plane by byte plane: the upper planes are mostly
    zeros, which the shuffle's compression removes."""
    return np.diff(ascending, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype("<u4")


def _probes(parts: int, window: int, block: int):
    """Map step 1: per part, the rolling runs' hashes (lower 32 bits; two copies if repeated in the
    batch) and the blocks with their document."""

    def flush(rolls, blocks):
        h = np.concatenate(rolls)
        key, n = np.unique((_deal(h, parts).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(2**32 - 1)), return_counts=True)
        key = np.repeat(key, np.minimum(n, 2))
        cuts = np.searchsorted(key >> np.uint64(32), np.arange(parts + 1))
        low = key.astype("<u4")
        bh = np.concatenate([b[0] for b in blocks])
        rows = np.empty(len(bh), _BLOCK_TYPE)
        rows["h"] = bh.astype(np.uint32)
        rows["b"] = np.concatenate([np.arange(len(b[0]), dtype=np.uint32) for b in blocks])
        rows["doc"] = np.repeat([b[1] for b in blocks], [len(b[0]) for b in blocks])
        rows["stamp"] = np.repeat([b[2] for b in blocks], [len(b[0]) for b in blocks])
        bpart = _deal(bh, parts)
        border = np.argsort(bpart, kind="stable")
        bcuts = np.searchsorted(bpart[border], np.arange(parts + 1))
        rows = rows[border]
        for a in range(0, parts, 64):  # a few parts at a time
            some = [p for p in range(a, min(a + 64, parts)) if cuts[p] < cuts[p + 1]]
            yield pa.record_batch(
                [pa.array(some, pa.int64()),
                 pa.array([_packed(low[cuts[p] : cuts[p + 1]]) for p in some], pa.binary()),
                 pa.array([rows[bcuts[p] : bcuts[p + 1]].tobytes() for p in some], pa.binary())],
                names=["part", "probes", "blocks"],
            )

    def run(batches):
        words, rolls, blocks, held = WordHash(), [], [], 0
        for batch in batches:
            docs, stamps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, stamp, text in zip(docs, stamps, as_bytes(batch.column(2))):
                h = words.of(text.split())
                if len(h) < window:
                    continue
                roll = window_hashes(h, block)
                rolls.append(roll)
                blocks.append((roll[::block], doc, stamp))
                held += len(roll)
                if held >= FLUSH:
                    yield from flush(rolls, blocks)
                    rolls, blocks, held = [], [], 0
        if rolls:
            yield from flush(rolls, blocks)

    return run


_HITS = pa.schema([("doc", pa.int64()), ("stamp", pa.int64()), ("b", pa.int64())])


def _hits(table: pa.Table) -> pa.Table:
    """Reduce step 1: blocks whose hash has two or more rolling runs in the whole part."""
    probes = np.sort(np.concatenate([_unpacked(x) for x in table["probes"].to_pylist()]))
    twice = np.unique(probes[1:][probes[1:] == probes[:-1]])
    blocks = np.concatenate([np.frombuffer(x, _BLOCK_TYPE) for x in table["blocks"].to_pylist()])
    if len(twice) and len(blocks):
        at = np.minimum(np.searchsorted(twice, blocks["h"]), len(twice) - 1)
        blocks = blocks[twice[at] == blocks["h"]]
    else:
        blocks = blocks[:0]
    return pa.table([pa.array(blocks["doc"]), pa.array(blocks["stamp"]), pa.array(blocks["b"].astype(np.int64))], schema=_HITS)


def _windows(parts: int, window: int, block: int):
    """Map step 2: the hashes of all windows around hit blocks, with their document and position."""

    def flush(held):
        h1 = np.concatenate([x[2] for x in held])
        h2 = np.concatenate([x[3] for x in held])
        pos = np.concatenate([x[4] for x in held]).astype("<u4")
        owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        part = _deal(h1, parts)
        order = np.argsort(part, kind="stable")  # keeps documents and positions in order
        h1, h2, pos, owner = h1[order].astype("<u8"), h2[order], pos[order], owner[order]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        docs, stamps = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        out = []
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            who, n = np.unique(owner[a:b], return_counts=True)
            owners = np.empty(len(who), _OWNER_TYPE)
            owners["doc"], owners["stamp"], owners["n"] = docs[who], stamps[who], n
            out.append((p, owners.tobytes(), h1[a:b].tobytes(), h2[a:b].tobytes(), pos[a:b].tobytes()))
        chunk = TaskContext.get().partitionId()
        for a in range(0, len(out), 64):
            cols = list(zip(*out[a : a + 64]))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int64()), pa.array([chunk] * len(cols[0]), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                names=["part", "chunk", "owners", "h1", "h2", "pos"],
            )

    def run(batches):
        words, held, total = WordHash(), [], 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist())
            for doc, stamp, text, hit in rows:
                h = words.of(text.split())
                n = len(h) - window + 1
                if n <= 0 or not hit:
                    continue
                flags = np.zeros(len(h) // block + 2, bool)
                flags[np.array(hit, np.int64)] = True
                start = np.flatnonzero(flags[-(-np.arange(n) // block)])
                if not len(start):
                    continue
                w1, w2 = window_hashes(h, window), window_hashes(h, window, 1)
                held.append((doc, stamp, w1[start], (w2[start] >> np.uint64(32)).astype("<u4"), start))
                total += len(start)
                if total >= FLUSH // 2:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


_REPEATS = pa.schema([("chunk", pa.int64()), ("owners", pa.binary()), ("pos", pa.binary())])


def _repeats(table: pa.Table) -> pa.Table:
    """Reduce step 2: of each row, the windows whose hash occurs twice or more in the whole part."""
    col = {c: table[c].to_pylist() for c in ("chunk", "owners", "h1", "h2", "pos")}
    h1, h2 = (np.frombuffer(b"".join(col[c]), k) for c, k in (("h1", "<u8"), ("h2", "<u4")))
    order = np.argsort(h1, kind="stable")
    s1 = h1[order]
    close = np.flatnonzero(s1[1:] == s1[:-1])
    if len(close) and (h2[order[close]] != h2[order[close + 1]]).any():  # equal first hashes, told apart by the second
        order = np.lexsort((h2, h1))
        s1 = h1[order]
    same = (s1[1:] == s1[:-1]) & (h2[order[1:]] == h2[order[:-1]])
    hit = np.zeros(len(h1), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    out, at = [], 0
    for chunk, owners, pos in zip(col["chunk"], col["owners"], col["pos"]):
        who, pos = np.frombuffer(owners, _OWNER_TYPE), np.frombuffer(pos, "<u4")
        mine = hit[at : at + len(pos)]
        at += len(pos)
        if not mine.any():
            continue
        owner = np.repeat(np.arange(len(who)), who["n"])[mine]
        left, n = np.unique(owner, return_counts=True)
        kept = who[left].copy()
        kept["n"] = n
        out.append((chunk, kept.tobytes(), pos[mine].tobytes()))
    cols = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _REPEATS)], schema=_REPEATS)


def _spans(window: int):
    """Merge step: the repeated windows of each document of a chunk as maximal spans of words."""
    schema = pa.schema([("doc", pa.int64()), ("stamp", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        owners = [np.frombuffer(x, _OWNER_TYPE) for x in table["owners"].to_pylist()]
        pos = np.frombuffer(b"".join(table["pos"].to_pylist()), "<u4").astype(np.int64)
        who = np.concatenate(owners) if owners else np.empty(0, _OWNER_TYPE)
        doc, stamp = np.repeat(who["doc"], who["n"]), np.repeat(who["stamp"], who["n"])
        order = np.lexsort((pos, stamp, doc))
        doc, stamp, pos = doc[order], stamp[order], pos[order]
        new_doc = np.ones(len(doc), bool)
        new_doc[1:] = (doc[1:] != doc[:-1]) | (stamp[1:] != stamp[:-1])
        new_span = new_doc.copy()
        new_span[1:] |= pos[1:] > pos[:-1] + window
        a = np.flatnonzero(new_span)
        b = np.append(a[1:], len(pos)) - 1
        first, last = pos[a], pos[b] + window - 1
        cut = np.append(np.flatnonzero(new_doc[a]), len(a)).astype(np.int32)
        heads = a[cut[:-1]]
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (first, last)]
        return pa.table([pa.array(doc[heads]), pa.array(stamp[heads]), *lists], schema=schema)

    return run, "doc long, stamp long, first array<long>, last array<long>"


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, block: int | None = None, parts: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Spans of words covered by a window whose words also stand anywhere else (same document included).

    One row per (doc, stamp) with repeats: arrays ``first`` and ``last`` of
    word positions, sorted and disjoint.  Words are runs without ASCII white
    space, unchanged.  Null text has no words; equal rows (same id and text)
    repeat each other; other columns are ignored.
    """
    block = block or (window + 1) // 2
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    parts = n_parts(docs, parts)
    probes = keyed.mapInArrow(_probes(parts, window, block), "part long, probes binary, blocks binary")
    hits = probes.groupBy("part").applyInArrow(_hits, "doc long, stamp long, b long")
    of_doc = hits.groupBy("doc", "stamp").agg(F.collect_list("b").alias("hit"))
    found = keyed.join(of_doc, ["doc", "stamp"]).select("doc", "stamp", "text", "hit").mapInArrow(
        _windows(parts, window, block), "part long, chunk long, owners binary, h1 binary, h2 binary, pos binary"
    )
    repeats = found.groupBy("part").applyInArrow(_repeats, "chunk long, owners binary, pos binary")
    merge, schema = _spans(window)
    return repeats.groupBy("chunk").applyInArrow(merge, schema)


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and the kept words joined by one space."""
    small_batches(docs.sparkSession)
    one = spans.groupBy("doc", "stamp").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    rows = _keyed(docs, id_col, text_col).join(one, ["doc", "stamp"], "left").select(_id(), "text", "first", "last")

    def cut(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, first, last in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                n.append(len(words))
                if first:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.array(last) + 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
