"""Secret scan: candidate strings, native features, and a random forest that removes false positives.

Only DataFrame functions and MLlib's forest: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import written

# A candidate: a whole run of at least 16 characters of keys, of any length, with a digit anywhere.
# Possessive, so each run is read once and long ones need no stack.
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
SPACES = r"[\x20\x09-\x0D]+"
TRAINING_ROWS = 20_000  # labelled findings the forest is fitted on at most, drawn by hash
DICTIONARY_SHARE = 5000  # a dictionary word occurs in one of so many documents, and in two at least
WORD_LENGTHS = (4, 12)
PIECE = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"  # letters of a candidate between case changes, digits and signs
FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "distinct_share", "transitions", "case_changes", "likelihood",
    "coverage", "is_path", "has_assignment", "key_before", "quoted", "number_before", "number_after", "long_before",
)
KEY_WORDS = r"(?i)(token|secret|passw|api|key|auth|bearer|credential|access)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every text: doc_id, word (its number), nth (within the word), candidate,
    and the words before, around and after it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    words = hits.select("doc_id", F.split("text", SPACES).alias("words"))
    each = words.select("doc_id", "words", F.posexplode("words").alias("word", "around")).where(F.col("around").rlike(CANDIDATE))
    near = each.select(
        "doc_id", "word", "around",
        F.coalesce(F.get("words", F.col("word") - 1), F.lit("")).alias("before"),
        F.coalesce(F.get("words", F.col("word") - 2), F.lit("")).alias("before2"),
        F.coalesce(F.get("words", F.col("word") + 1), F.lit("")).alias("after"),
    )
    found = near.withColumn("all", F.regexp_extract_all("around", F.lit(CANDIDATE), F.lit(0)))
    return found.select("doc_id", "word", F.posexplode("all").alias("nth", "raw"), "around", "before", "before2", "after").withColumn(
        "candidate", F.regexp_replace("raw", r"^[A-Za-z_]{2,20}=(?=.{8})", "")
    )


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """entry, n: words of 4 to 12 letters and the number of their documents, over the whole corpus.

    Words of fewer than one in ``DICTIONARY_SHARE`` documents (or of one) are
    left out, which bounds the dictionary by ``DICTIONARY_SHARE`` times the
    distinct words of a mean document at any corpus size.
    """
    least = max(2, -(-docs.count() // DICTIONARY_SHARE))
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    words = docs.select(F.explode(F.array_distinct(F.split(text, r"[^a-z]+"))).alias("entry"))
    words = words.where(F.length("entry").between(*WORD_LENGTHS))
    return words.groupBy("entry").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter_pairs(text: Column) -> Column:
    """Each two neighbouring characters of a text."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))


def letter_model(words: DataFrame) -> DataFrame:
    """pair, log_p: log probability of a letter after another in dictionary words (weighted by their documents,
    each pair counted once more); 26 * 26 rows."""
    seen = words.select("n", F.explode(_letter_pairs(F.col("entry"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    letters = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.char(i))
    grid = words.sparkSession.range(1).select(F.explode(letters).alias("a")).select("a", F.explode(letters).alias("b"))
    both = grid.select("a", F.concat("a", "b").alias("pair")).join(seen, "pair", "left").select("a", "pair", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    totals = both.groupBy("a").agg(F.sum("n").alias("total"))
    return both.join(totals, "a").select("pair", F.log(F.col("n") / F.col("total")).alias("log_p"))


def _likelihood(distinct: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, likelihood: mean log probability of its letter transitions."""
    pairs = distinct.select("candidate", F.explode(_letter_pairs(F.lower("candidate"))).alias("pair")).groupBy("candidate", "pair").agg(F.count("*").alias("times"))
    known = pairs.join(F.broadcast(letter_model(words)), "pair")  # 676 rows
    return known.groupBy("candidate").agg((F.sum(F.col("times") * F.col("log_p")) / F.sum("times")).alias("likelihood"))


def _covered(distinct: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, covered: characters in dictionary words that stand inside its pieces."""
    piece = F.posexplode(F.regexp_extract_all("candidate", F.lit(PIECE), F.lit(0))).alias("piece", "letters")
    pieces = distinct.select("candidate", piece).where(F.length("letters") >= WORD_LENGTHS[0])
    starts = pieces.select("candidate", "piece", F.lower("letters").alias("letters"), F.explode(F.sequence(F.lit(1), F.length("letters") - WORD_LENGTHS[0] + 1)).alias("b"))
    # the letters from a start on are cut once; words of each length are their beginnings
    tails = starts.select("candidate", "piece", "b", F.substring("letters", F.col("b"), F.lit(WORD_LENGTHS[1])).alias("tail"))
    sizes = F.explode(F.sequence(F.lit(WORD_LENGTHS[0]), F.length("tail"))).alias("size")
    parts = tails.select("candidate", "piece", "b", "tail", sizes).select("candidate", "piece", "b", (F.col("b") + F.col("size")).alias("e"), F.substring("tail", F.lit(1), F.col("size")).alias("entry"))
    longest = parts.join(words.select("entry"), "entry").groupBy("candidate", "piece", "b").agg(F.max("e").alias("e"))
    before = Window.partitionBy("candidate", "piece").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest("b", F.coalesce(F.max("e").over(before), F.lit(0))))
    return longest.select("candidate", new.alias("new")).groupBy("candidate").agg(F.sum("new").alias("covered"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with ``FEATURES``: ``coverage`` is the share of characters in dictionary words,
    ``likelihood`` the mean log probability of the letter transitions (log(1/26) without any)."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    distinct = found.select("candidate").distinct()
    safe = F.greatest(n, F.lit(1.0))
    both = found.join(_covered(distinct, words), "candidate", "left").join(_likelihood(distinct, words), "candidate", "left")
    before = F.concat_ws(" ", "before2", "before")
    return both.select(
        "doc_id", "word", "nth", "candidate", "around", "before", "before2",
        n.alias("length"),
        (_count(c, "[0-9]") / safe).alias("digit_share"),
        (_count(c, "[A-Z]") / safe).alias("upper_share"),
        (_count(c, "[0-9a-f]") / safe).alias("hex_share"),
        (F.size(F.array_distinct(F.split(c, ""))) / safe).alias("distinct_share"),
        (_count(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / safe).alias("transitions"),
        (_count(c, "(?<=[a-z])(?=[A-Z])") / safe).alias("case_changes"),
        F.round(F.coalesce("likelihood", F.log(F.lit(1 / 26))), 9).alias("likelihood"),
        (F.coalesce("covered", F.lit(0)) / safe).alias("coverage"),
        (F.col("around").rlike(r"://|\.[a-z]{2,4}/|/[^/]+/") | c.rlike("/[a-z]+/")).cast("double").alias("is_path"),
        F.col("around").rlike(r"^[\"']?[A-Za-z_]{2,20}[=:]").cast("double").alias("has_assignment"),
        before.rlike(KEY_WORDS).cast("double").alias("key_before"),
        F.col("around").rlike("[\"']").cast("double").alias("quoted"),
        F.col("before").rlike("^[+0-9().-]+$").cast("double").alias("number_before"),
        F.col("after").rlike("^[+0-9().-]+$").cast("double").alias("number_after"),
        (F.length("before") > 15).cast("double").alias("long_before"),
    )


# Formats that decide alone, and the features that restate each: 1 for provider-format and assigned keys,
# 0 for bare numbers and addresses.
FORMATS = {
    "provider": (1.0, ()), "quoted": (1.0, ("key_before", "quoted")), "assigned": (1.0, ("has_assignment", "quoted")),
    "number": (0.0, ("digit_share",)), "address": (0.0, ("is_path",)),
}


def weak_labels(rows: DataFrame) -> DataFrame:
    """Labelled findings (``format``, ``label``) of formats that decide alone; other candidates have none."""
    c, a = F.col("candidate"), F.col("around")
    provider = c.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bap]-[0-9A-Za-z-]{10,})$")
    quoted = F.concat_ws(" ", "before2", "before").rlike(r"(?i)(token|secret|password|api_?key)\s*[=:]$") & a.rlike("^[\"']")
    assigned = a.rlike(r"(?i)^[\"']?(token|secret|password|passwd|api_?key)[=:]")
    kind = F.when(provider, "provider").when(quoted, "quoted").when(assigned, "assigned").when(c.rlike("^[0-9]+$"), "number").when(a.rlike("://"), "address")
    label = F.element_at(F.create_map(*[x for k, (v, _) in FORMATS.items() for x in (F.lit(k), F.lit(v))]), F.col("format"))
    return rows.withColumn("format", kind).where("format is not null").withColumn("label", label)


def _blanked(labelled: DataFrame) -> DataFrame:
    """Each labelled finding, and again with the features that restate its format left out (0), so that the forest
    has to decide by the others too."""
    if "format" not in labelled.columns:
        return labelled
    restates = {f: [k for k, (_, names) in FORMATS.items() if f in names] for f in FEATURES}
    blank = [F.when(F.col("format").isin(kinds), F.lit(0.0)).otherwise(F.col(f)).alias(f) if (kinds := restates[f]) else F.col(f) for f in FEATURES]
    rest = [c for c in labelled.columns if c not in FEATURES]
    return labelled.unionByName(labelled.select(*rest, *blank))


def held_out_formats(labelled: DataFrame) -> DataFrame:
    """format, label, n, n_right: findings of each format judged by a forest that has seen the other formats only."""
    out = None
    for kind in FORMATS:
        model = fit_forest(labelled.where(F.col("format") != kind))
        if model is None:
            continue
        judged = model.transform(labelled.where(F.col("format") == kind))
        part = judged.groupBy("format", "label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right"))
        out = part if out is None else out.unionByName(part)
    return out


def fit_forest(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = 20, depth: int = 6, seed: int = 7):
    """Random forest on at most ``rows`` labelled findings: half of each label (those with the
    smallest hashes), more where the other label has fewer; None unless both labels occur."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("candidate", "doc_id", "word", "nth")
    drawn = None
    for label, n in sorted(counts.items()):
        take = min(n, max(rows // 2, rows - (sum(counts.values()) - n)))
        part = labelled.where(F.col("label") == label).orderBy(order, "candidate", "doc_id", "word", "nth").limit(take)
        drawn = part if drawn is None else drawn.unionByName(part)
    sample = written(_blanked(drawn).select(*FEATURES, "label"), "findings")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample.coalesce(1))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word, nth, sha256 (of the candidate), length, score, is_secret.

    ``labelled`` holds findings with FEATURES and ``label``; without it the
    formats of ``weak_labels`` label the corpus' own findings.  A forest needs
    both labels; without them every candidate scores 1 (nothing is removed).
    Null and empty texts have no candidates; a null id stays null; repeated
    rows repeat their candidates; other columns are ignored; an empty table
    gives no rows.  Whole texts are scanned; only candidates are shuffled,
    besides the dictionary's word counts.
    """
    found = written(candidates(docs, id_col, text_col), "candidates")
    rows = written(features(found, dictionary(docs, text_col=text_col)), "features")
    model = fit_forest(weak_labels(rows) if labelled is None else labelled)
    keys = ("doc_id", "word", "nth", F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"), F.col("length").cast("long").alias("length"))
    if model is None:
        return rows.select(*keys, F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    scored = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*keys, "score", (F.col("score") >= 0.5).alias("is_secret"))
