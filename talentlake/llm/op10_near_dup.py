"""MinHash near-duplicates with tensored banding, verified on full shingle sets.

Two small collections of ``halves`` half-band hashes (``rows`` minhashes each)
stand for halves * halves tables: the key of table (i, j) combines half-band i
of the first with half-band j of the second.  So 2 * halves * rows minhashes
serve halves ** 2 tables of 2 * rows minhashes.  A pair of similarity s is
missed with a chance of about 2 * (1 - s ** rows) ** halves, under 1e-4 at 0.8.

A bucket's sets are compared with its centre only (a star, never all pairs).
Sets of buckets that still hold several components are then joined exactly
between components, by prefix, length and positional filters over shingles in
a global order (``residual_pairs``), which finds every pair that stars left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentlake.llm.common import WordHash, as_bytes, mix64, small_batches, window_hashes, written
from talentlake.llm.components import connected_components
from talentlake.llm.op02_line_dedup import text_stamp

ROWS, HALVES = 3, 14
FLUSH = 1_000_000  # shingles a map task holds before it deals them out
BIN = 1.05  # width of the set-size classes of the residual join

_OWNER_TYPE = np.dtype([("node", "<i8"), ("comp", "<i8"), ("size", "<u4"), ("n", "<u4")])

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: bytes, words: WordHash, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles (A-Z lower-cased, ASCII white space)."""
    h = words.of(text.translate(_LOWER).split())
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(size, len(h))))


def _signature(shingles: np.ndarray, rows: int, halves: int) -> np.ndarray:
    """Half-band hashes: ``halves`` of each of the two collections."""
    n = 2 * halves * rows
    k = np.arange(1, n + 1, dtype=np.uint64)[:, None]
    low = np.full(n, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        flip, mult = mix64(k), mix64(k + np.uint64(1 << 32)) | np.uint64(1)
        for at in range(0, len(shingles), 4096):
            np.minimum(low, ((shingles[None, at : at + 4096] ^ flip) * mult).min(axis=1), out=low)
        out = mix64(low[0::rows] + np.arange(2 * halves, dtype=np.uint64))
        for r in range(1, rows):
            out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + low[r::rows])
    return out


def signatures(docs: DataFrame, size: int, rows: int, halves: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, stamp (of the text), n_shingles, a 128-bit key of the set (s1, s2) and the half-band hashes."""
    small_batches(docs.sparkSession)

    def sign(batches):
        words = WordHash()
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingle_set(text, words, size)
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                bands.append(_signature(s, rows, halves).astype(np.int64) if len(s) else None)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "stamp", "n_shingles", "s1", "s2", "bands"],
            )

    rows_ = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").withColumn("stamp", text_stamp(F.col("text")))
    return rows_.mapInArrow(sign, "doc_id long, stamp long, n_shingles long, s1 long, s2 long, bands array<long>")


def tensored_keys(classes: DataFrame, halves: int) -> DataFrame:
    """node, n_shingles, key: the table keys of every class that shares both of their half-bands.

    Half-bands that occur once can match nothing and are left out before they
    are combined, so documents without neighbours make no keys.
    """
    half = classes.select("node", "n_shingles", F.posexplode("bands").alias("k", "h"))
    half = half.select("node", "n_shingles", "k", F.xxhash64("k", "h").alias("h"))
    shared = half.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    own = half.join(shared, "h").groupBy("node", "n_shingles").agg(F.collect_list(F.struct("k", "h")).alias("b"))
    side = lambda first: F.transform(F.filter("b", lambda x: (x["k"] < halves) == first), lambda x: x["h"])
    pairs = own.select("node", "n_shingles", F.explode(side(F.lit(True))).alias("u"), side(F.lit(False)).alias("vs"))
    return pairs.select("node", "n_shingles", "u", F.explode("vs").alias("v")).select(
        "node", "n_shingles", F.xxhash64("u", "v").alias("key")
    )


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Pairs are sorted by the side that repeats (b, the star's centre), whose set
    is made once per run; a centre with many pairs is split by the join.
    """
    left = pairs.join(texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a")
    both = left.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")

    def confirm(batches):
        words, centre, of = WordHash(), None, None
        for batch in batches:
            ok, a, b = [], as_bytes(batch.column(2)), batch.column(1).to_pylist()
            text_b = batch.column(3)
            for k, text in enumerate(a):
                if b[k] != of:
                    centre, of = shingle_set(text_b[k].as_buffer().to_pybytes(), words, size), b[k]
                s = shingle_set(text, words, size)
                common = len(np.intersect1d(s, centre, assume_unique=True))
                ok.append(100 * common >= percent * (len(s) + len(centre) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return both.select("a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary")).mapInArrow(confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, halves: int = HALVES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Sets: distinct ``size``-word shingles, with fewer words the whole sequence
    as one, without words empty and linked with nothing.  Two documents are
    linked at 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable.  Equal sets are one class, which is compared
    once; texts that share a doc_id are compared each on its own.  Rows with a
    null id are linked with nothing (component_id null, kept).  Repeated rows
    give repeated results.  Null text counts as empty; other columns are
    ignored; an empty table gives an empty result.
    """
    signed = written(signatures(docs, size, rows, halves, id_col, text_col), "signatures")
    known = signed.where("doc_id is not null and n_shingles > 0")
    linked = _linked(docs, known, size, percent, halves, id_col, text_col)
    own = known.select("doc_id", "n_shingles", "s1", "s2").join(linked, ["s1", "s2"])
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = own.select("doc_id", "n_shingles", F.col("first_id").alias("component_id")).unionByName(rest)
    return out.withColumn("kept", F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def row_marks(
    docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, halves: int = HALVES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per distinct (doc_id, stamp of the text) that has words: doc_id, stamp, n_rows, kept.

    Unlike ``near_duplicates`` all rows are compared, those without an id too,
    and a single (doc_id, stamp) of each group is kept: that of the smallest
    doc_id (null is the last), then of the smallest stamp.
    """
    signed = written(signatures(docs, size, rows, halves, id_col, text_col), "signatures")
    known = signed.where("n_shingles > 0")
    linked = _linked(docs, known, size, percent, halves, id_col, text_col)
    distinct = known.groupBy("doc_id", "stamp", "s1", "s2").agg(F.count("*").alias("n_rows"))
    kept = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("stamp") == F.col("first_stamp"))
    return written(distinct, "rows").join(linked, ["s1", "s2"]).select("doc_id", "stamp", "n_rows", kept.alias("kept"))


def _linked(docs: DataFrame, known: DataFrame, size: int, percent: int, halves: int, id_col: str, text_col: str) -> DataFrame:
    """s1, s2 of every class of ``known``, first_id and first_stamp: the first row of its component.

    Nodes are numbers of the classes in the order of their first rows, so the
    smallest node of a component leads to the component's first row.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "stamp")).alias("f")
    ordered = known.groupBy("s1", "s2").agg(first).select("s1", "s2", "f.*").orderBy("nameless", "doc_id", "stamp", "s1", "s2")
    # Written, so that the numbers hold and the joins below are plain ones, whose hot keys Spark can split.
    classes = written(
        ordered.select("s1", "s2", F.col("doc_id").alias("first_id"), F.col("stamp").alias("first_stamp"), F.monotonically_increasing_id().alias("node")),
        "classes",
    )
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("stamp") == F.col("first_stamp"))
    heads = known.join(classes, ["s1", "s2"]).where(is_first).dropDuplicates(["node"]).select("node", "n_shingles", "bands")
    keys = tensored_keys(heads, halves)
    # Buckets of two classes or more; the smallest node is the first centre.
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    members = written(keys.join(buckets.select("key", "centre"), "key"), "members")
    texts = _texts(docs, classes, members, id_col, text_col)

    sizes = members.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    stars = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(_sizes_fit(stars, sizes, percent), "stars")
    links = written(verified(stars, texts, size, percent), "links")
    labels = connected_components(links)
    rest = residual_pairs(_mixed(members, labels), texts, size, percent)
    rest = written(rest.join(stars.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(written(verified(rest, texts, size, percent), "links"))
        labels = connected_components(links)
    own = written(classes.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component")), "components")
    heads_of = classes.select(F.col("node").alias("component"), "first_id", "first_stamp")
    return written(own.join(heads_of, "component").select("s1", "s2", "first_id", "first_stamp"), "linked")


def _texts(docs: DataFrame, classes: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of the classes that share a bucket, written once: all that later joins move."""
    nodes = classes.join(members.select("node").distinct(), "node").select("node", "first_id", "first_stamp")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_stamp(text).alias("stamp"), text.alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("stamp") == F.col("first_stamp"))
    return written(rows.join(nodes, on).select("node", "text").dropDuplicates(["node"]), "texts")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """node, comp of the members of buckets that hold more than one component."""
    own = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    span = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return own.join(span.select("key"), "key").select("node", "comp").distinct()


def _deal_shingles(parts: int, size: int):
    """Map step: the shingles of every set, dealt by value into parts, with their owners."""

    def flush(held):
        h = np.concatenate([x[2] for x in held])
        owner = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        h, owner = h[order].astype("<u8"), owner[order]
        who = np.array([(x[0], x[1], len(x[2]), 0) for x in held], _OWNER_TYPE)
        chunk = TaskContext.get().partitionId()
        rows = []
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            mine, n = np.unique(owner[a:b], return_counts=True)
            owners = who[mine]
            owners["n"] = n
            rows.append((int(p), chunk, owners.tobytes(), h[a:b].tobytes()))
        for a in range(0, len(rows), 64):
            cols = list(zip(*rows[a : a + 64]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "chunk", "owners", "h"])

    def run(batches):
        words, held, total = WordHash(), [], 0
        for batch in batches:
            for node, comp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                held.append((node, comp, shingle_set(text, words, size)))
                total += len(held[-1][2])
                if total >= FLUSH:
                    yield from flush(held)
                    held, total = [], 0
        if held:
            yield from flush(held)

    return run


_SHARED = pa.schema([("chunk", pa.int64()), ("owners", pa.binary()), ("h", pa.binary()), ("n", pa.binary())])


def _shared_shingles(table: pa.Table) -> pa.Table:
    """Reduce step: of each row, the shingles that stand in sets of two components or more, with their counts."""
    owners = [np.frombuffer(x, _OWNER_TYPE) for x in table["owners"].to_pylist()]
    h = np.frombuffer(b"".join(table["h"].to_pylist()), "<u8")
    comp = np.concatenate([np.repeat(o["comp"], o["n"]) for o in owners])
    order = np.argsort(h, kind="stable")
    s, c = h[order], comp[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    count = np.diff(np.append(first, len(s)))
    both = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    hit, n = np.zeros(len(h), bool), np.zeros(len(h), "<u4")
    hit[order], n[order] = np.repeat(both, count), np.repeat(count, count)
    out, at = [], 0
    for chunk, o in zip(table["chunk"].to_pylist(), owners):
        mine = slice(at, at + int(o["n"].sum()))
        at = mine.stop
        own = hit[mine]
        if not own.any():
            continue
        left, k = np.unique(np.repeat(np.arange(len(o)), o["n"])[own], return_counts=True)
        kept = o[left].copy()
        kept["n"] = k
        out.append((chunk, kept.tobytes(), h[mine][own].tobytes(), n[mine][own].tobytes()))
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(x, f.type) for x, f in zip(cols, _SHARED)], schema=_SHARED)


def _prefixes(percent: int):
    """Merge step: the shared shingles within each set's prefix, with their position.

    Order: shingles of one component first (they match nothing that is asked
    for), then by count, then by value.
    """
    names = ("node", "comp", "size", "h", "i")
    schema = pa.schema([(x, pa.int64()) for x in names])

    def run(table: pa.Table) -> pa.Table:
        owners = np.concatenate([np.frombuffer(x, _OWNER_TYPE) for x in table["owners"].to_pylist()])
        h = np.frombuffer(b"".join(table["h"].to_pylist()), "<u8")
        n = np.frombuffer(b"".join(table["n"].to_pylist()), "<u4")
        node, comp, size = (np.repeat(owners[x], owners["n"]).astype(np.int64) for x in ("node", "comp", "size"))
        order = np.lexsort((h, n, node))
        node, comp, size, h = node[order], comp[order], size[order], h[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        m = np.diff(np.append(first, len(node)))
        i = np.arange(len(node)) - np.repeat(first, m) + size - np.repeat(m, m)
        keep = i < size - -(-percent * size // 100) + 1
        cols = (node, comp, size, h.view(np.int64), i)
        return pa.table([pa.array(x[keep]) for x in cols], schema=schema)

    return run, ", ".join(f"{x} long" for x in names)


def residual_pairs(mixed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that may reach the similarity: none that does is missing.

    Two sets that reach it share a shingle of both prefixes; at the first such
    one the shingles that follow must suffice.  That bounds the other set's
    size on either side, so the join's key holds both sets' size classes, and
    only pairs near both bounds meet.
    """
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = texts.join(mixed, "node").select("node", "comp", "text")
    dealt = rows.mapInArrow(_deal_shingles(parts, size), "part long, chunk long, owners binary, h binary")
    shared = dealt.groupBy("part").applyInArrow(_shared_shingles, "chunk long, owners binary, h binary, n binary")
    merge, schema = _prefixes(percent)
    tokens = written(shared.groupBy("chunk").applyInArrow(merge, schema), "prefixes")
    size_, left = F.col("size"), F.col("size") - F.col("i")
    limit = F.floor(((100 + percent) * left - percent * size_) / percent)  # largest partner by position
    bin_ = lambda x: F.floor(F.log(x.cast("double")) / float(np.log(BIN)))
    lo, hi = F.ceil(percent * size_ / 100), F.least(limit, size_)
    large = tokens.where(lo <= hi).select(
        "h", bin_(size_).alias("u"), F.explode(F.sequence(bin_(lo), bin_(hi))).alias("v"),
        F.col("node").alias("a"), F.col("comp").alias("ca"), size_.alias("na"), limit.alias("la"),
    )
    top = F.least(limit, F.floor(100 * size_ / percent))
    small = tokens.where(size_ <= top).select(
        "h", F.explode(F.sequence(bin_(size_), bin_(top))).alias("u"), bin_(size_).alias("v"),
        F.col("node").alias("b"), F.col("comp").alias("cb"), size_.alias("nb"), limit.alias("lb"),
    )
    fits = "ca <> cb and nb <= na and nb <= la and na <= lb and 100 * nb >= {} * na".format(percent)
    found = large.join(small, ["h", "u", "v"]).where(fits)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _sizes_fit(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Length filter: the smaller set must reach the share of the larger."""
    a = sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"))
    b = sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    return pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
