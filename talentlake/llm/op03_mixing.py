"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = min(2, exp(lambda * size / mean size of its source)),
the exponential tilt that changes the documents' rates least (in entropy)
while each source's words meet its target.  The convex dual separates by
source: one multiplier each, found by safeguarded Newton steps whose sums are
grouped aggregates over all documents.  Sums are in fixed point, so reruns and
other partitionings agree to the last bit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import written
from talentlake.llm.op02_line_dedup import text_stamp

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
MAX_SOURCES = 100_000  # their totals and multipliers pass through the driver; more is an error
MOST = 2.0  # copies of a document, and words of a source against its size
UNIT = 1 << 20  # fixed point of rates
LN_MOST = math.log(MOST)
KEY = ("doc_id", "source", "size", "stamp")
ORDER = "xxhash64(coalesce(doc_id, stamp))"  # of rows of one size; without an id by the text


def source_targets(
    sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = MOST
) -> dict[str | None, float]:
    """Targets of the sources, ordered by code point with null last, weights repeating.

    They share ``share`` times all sizes; one above ``most`` times its size stops
    there and its excess is shared again by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
        left = max(left, 0.0)
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words of the text; null text has none) and stamp of the text of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text_stamp(text).alias("stamp"),
    )


class _Dual:
    """Newton state of one source's multiplier."""

    def __init__(self, total: int, n: int, target: float):
        self.total, self.target, self.mean = total, target, max(total / max(n, 1), 1.0)
        self.low, self.high = -math.inf, math.inf
        self.at = 0.0
        self.done = target <= 0 or target >= MOST * total
        if target <= 0:
            self.at = -math.inf
        elif self.done:
            self.at = math.inf

    def step(self, words: float, slope: float, tolerance: float) -> None:
        gap = words - self.target
        if abs(gap) <= max(0.5, tolerance * self.target):
            self.done = True
            return
        if gap < 0:
            self.low = self.at
        else:
            self.high = self.at
        new = self.at - gap / slope if slope > 0 else math.nan
        if not self.low < new < self.high:
            if math.isinf(self.high):
                new = max(1.0, 2 * self.at) if self.at > -1 else self.at / 2
            elif math.isinf(self.low):
                new = min(-1.0, 2 * self.at) if self.at < 1 else self.at / 2
            else:
                new = (self.low + self.high) / 2
        self.done = new == self.at or self.high - self.low < 1e-12
        self.at = new


def _with(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """Join one small row per source (at most MAX_SOURCES of them, so a broadcast is bounded)."""
    names = [x.split()[0] for x in schema.split(", ")]
    small = rows.sparkSession.createDataFrame(values, f"_source string, {schema}")
    return rows.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("_source")), "left").select(
        *rows.columns, *names
    )


def _rate():
    z = F.col("lam") * F.col("size") / F.col("mean")
    return F.when(F.col("size") == 0, F.lit(0.0)).when(z >= LN_MOST, F.lit(MOST)).otherwise(F.exp(z))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, tolerance: float = 1e-4, rounds: int = 60,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per distinct (doc_id, source, text): size, stamp (of the text), n_rows, source_size, target, rate,
    copies (0, 1, 2) and n_more, how many of its rows get one copy more.

    Rates become copies by systematic rounding along the rows of a source
    ordered by size, so rounding errors cancel between neighbours; then up to
    three rows a source change by one copy to bring its words nearest to the
    target.  Equal rows are rounded together and differ by one copy at most.
    Null source is a source of its own, the last; null id is an id like others;
    documents without words are not taken; other columns are ignored; an empty
    table gives no rows.
    """
    base = sized(docs, id_col, text_col, source_col).groupBy(*KEY).agg(F.count("*").alias("n_rows"))
    rows = written(base.withColumn("weighted", F.col("size") * F.col("n_rows")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("weighted").alias("total"), F.sum("n_rows").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r.source: r.total for r in totals}
    targets = source_targets(sizes, weights, share)
    duals = {r.source: _Dual(r.total, r.n, targets[r.source]) for r in totals}
    n_docs = sum(r.n for r in totals)

    def lam(d: _Dual) -> float:
        return max(min(d.at, 1e9), -1e9)

    for _ in range(rounds):
        active = {s: d for s, d in duals.items() if not d.done}
        if not active:
            break
        part = _with(rows, [(s, lam(d), d.mean) for s, d in active.items()], "lam double, mean double").where("lam is not null")
        rate, z = _rate(), F.col("size") / F.col("mean")
        words = F.round(F.col("weighted") * rate * 1024).cast("decimal(28,0)")
        slope = F.when(F.col("lam") * z < LN_MOST, F.round(F.col("weighted") * z * rate * 1024)).otherwise(0).cast("decimal(28,0)")
        for r in part.groupBy("source").agg(F.sum(words).alias("w"), F.sum(slope).alias("d")).collect():
            active[r.source].step(float(r.w) / 1024, float(r.d) / 1024, tolerance)

    solved = [(s, lam(d), d.mean, d.total, float(targets[s])) for s, d in duals.items()]
    rated = _with(rows, solved, "lam double, mean double, source_size long, target double")
    rated = rated.withColumn("fixed", F.round(_rate() * UNIT).cast("long")).withColumn("part", F.col("fixed") % UNIT * F.col("n_rows"))
    # Systematic rounding: prefix sums of the fractions in two levels, size class by size class.
    n_sub = max(1, math.isqrt(n_docs) // 4)
    rated = rated.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 4)).withColumn(
        "sub", F.pmod(F.expr(ORDER), F.lit(n_sub))
    )
    cell = ["source", "class", "sub"]
    sums = rated.groupBy(*cell).agg(F.sum("part").alias("sum"))
    before = Window.partitionBy("source").orderBy("class", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_{c}") for c in cell), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    w = Window.partitionBy(*cell).orderBy("size", F.expr(ORDER), "doc_id", "stamp")
    inside = rated.withColumn("cum", F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("sub") == F.col("_sub"))
    placed = inside.join(starts, on).withColumn("upto", F.col("start") + F.col("cum") + UNIT // 2)
    extra = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("part")) / UNIT)
    every = F.floor(F.col("fixed") / UNIT) * F.col("n_rows") + extra
    out = placed.select(*KEY, "n_rows", "source_size", "target", (F.col("fixed") / UNIT).alias("rate"), every.alias("every"))
    near = _near_target(written(out, "mix-copies"), targets)
    return near.select(
        *KEY, "n_rows", "source_size", "target", "rate", F.floor(F.col("every") / F.col("n_rows")).cast("int").alias("copies"),
        (F.col("every") % F.col("n_rows")).alias("n_more"),
    )


def _near_target(out: DataFrame, targets: dict[str | None, float], rounds: int = 3) -> DataFrame:
    """Change single rows by one copy where that brings a source nearer to its target (``every``: copies of all equal rows)."""
    changes: list[tuple] = []
    current = out
    for _ in range(rounds):
        taken = {r.source: r.t for r in current.groupBy("source").agg(F.sum(F.col("size") * F.col("every")).alias("t")).collect()}
        gaps = [(s, targets[s] - t) for s, t in taken.items() if abs(targets[s] - t) >= 1]
        if not gaps:
            break
        open_ = _with(current, gaps, "gap double").where("gap is not null and size > 0")
        can = ((F.col("gap") > 0) & (F.col("every") < MOST * F.col("n_rows"))) | ((F.col("gap") < 0) & (F.col("every") > 0))
        off = F.abs(F.abs("gap") - F.col("size"))
        better = open_.where(can & (off < F.abs("gap")))
        best = better.groupBy("source").agg(
            F.min(F.struct(off.alias("off"), F.expr(ORDER).alias("h"), "doc_id", "size", "stamp", F.signum("gap").cast("int").alias("by"))).alias("b")
        )
        found = [(r.source, r.b.doc_id, r.b.size, r.b.stamp, r.b.by) for r in best.collect()]
        if not found:
            break
        changes += found
        current = _changed(out, changes)
    return current


def _changed(out: DataFrame, changes: list[tuple]) -> DataFrame:
    """``out`` with the changes (at most three a source) added to its copies."""
    sums: dict[tuple, int] = {}
    for *key, by in changes:
        sums[tuple(key)] = sums.get(tuple(key), 0) + by
    small = out.sparkSession.createDataFrame([(*k, v) for k, v in sums.items()], "_source string, _doc long, _size long, _stamp long, by int")
    on = (F.col("size") == F.col("_size")) & (F.col("stamp") == F.col("_stamp"))
    both = out.join(F.broadcast(small), on & F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return both.withColumn("every", F.col("every") + F.coalesce("by", F.lit(0))).select(*out.columns)


def mix_rows(mixed: DataFrame) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, source."""
    each = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    each = each.withColumn("copies", F.col("copies") + (F.col("_row") <= F.col("n_more")).cast("int"))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed_documents(
    docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents themselves, each as often as it has copies (null source and id included).

    Rows of one id, source and text may differ in other columns; where only
    some of them get one copy more, it is the row that is first as JSON.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized_docs = docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_stamp", text_stamp(text))
    names = {"doc_id": "_m_id", "source": "_m_source", "size": "_m_size", "stamp": "_m_stamp"}
    on = (
        F.col(id_col).cast("long").eqNullSafe(F.col("_m_id"))
        & F.col(source_col).cast("string").eqNullSafe(F.col("_m_source"))
        & (F.col("_size") == F.col("_m_size")) & (F.col("_stamp") == F.col("_m_stamp"))
    )

    def picked(often: str) -> DataFrame:
        return mixed.where(F.col(often) > 0).select(*[F.col(c).alias(n) for c, n in names.items()], F.col(often).cast("long").alias("_copies"))

    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    whole = sized_docs.join(picked("copies"), on).select(*(docs[c] for c in docs.columns), times).drop("_copy")
    row = F.struct(*(docs[c] for c in docs.columns))
    first = sized_docs.join(picked("n_more"), on).groupBy(*names.values(), "_copies").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    more = first.select("_row", times).select("_row.*")
    return whole.unionByName(more)
