import random

import pytest

#: Columns that clash with names the operators use inside.
CLASHING = ("fp", "size", "shard", "slot", "pii", "n_words", "quality", "kept", "_part", "_row", "_t", "component_id", "answers", "length")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, shared passages."""
    passage, long = prose(1, 60), prose(2, 60_000, 50_000)
    rows = [(i, prose(i + 10, 30 + 7 * i)) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "one two"), (45, "x" * 20_000)]
    rows += [(50 + i, f"{prose(100 + i, 25)} {passage} {prose(200 + i, 25)}") for i in range(6)]
    rows += [(60, rows[3][1]), (61, rows[3][1].upper()), (62, rows[3][1] + " tail"), (63, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(70, long), (71, long + " end"), (None, "no id here"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(3)
    extra = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])
    folder = f"{spark.sparkContext.getCheckpointDir()}/edge-docs"
    extra.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp string")
