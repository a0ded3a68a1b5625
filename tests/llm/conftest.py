import duckdb
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, with clashing and extra columns."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        extra = "1 pos", "2 n", "3 h1", "4 size", "'x' labels", "5 node", "6 stamp", "7 part", "8 copies", "9 word"
        return df.selectExpr("*", *extra)

    return make


@pytest.fixture(scope="session")
def tables():
    """DuckDB over the documents of a Spark frame."""

    def run(df, sql):
        con = duckdb.connect()
        documents = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
        con.register("documents", documents)
        return con.sql(sql).fetchall(), [c[0] for c in con.sql(sql).description]

    return run


WORDS = [f"w{i}" for i in range(400)] + ["Éa", "ñb", "the", "of", "x###"]
LONG = "the long line that stands in many documents and is over forty characters"


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with copies, near copies, shared passages, common lines and odd rows."""
    import random

    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage, base, rows = text(60), text(120), []
    for i in range(30):
        rows.append((i, text(rnd.randint(1, 200)) + ("\n" + LONG if i % 3 == 0 else ""), f"s{i % 4}"))
    for i in range(30, 40):
        words = base.split()
        words[rnd.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words), "s9"))
    for i in range(40, 46):
        rows.append((i, text(20) + "\n" + passage + "\n  " + LONG.upper() + " \n" + text(15), "s1"))
    rows += [(50, rows[3][1], "s1"), (51, rows[3][1], None), (52, "", "s2"), (53, None, "s2"), (54, " \n \t", None), (55, "one", "s3")]
    rows += [(56, "a " * 3000, "s3"), (57, "tiny", "s1"), (58, "tiny", "s1"), (59, "\n".join([LONG] * 4), "s0"), (60, "éÉ ñ " * 30, "s0")]
    return rows
