"""The pipeline's stages against what each promises, and the registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

from noticeframe.llm.oracles import ORACLES
from noticeframe.llm.queries import QUERIES

from ..test_catalog import plain

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_stages(spark):
    import corpus_pipeline as p
    from noticeframe.llm import decontam

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, out = docs.columns, docs
    kept = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, out, DATA).cache()
        assert out.columns == columns, name
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    for r in out.select("text").collect():
        own = decontam.shingles(decontam.words(r.text))
        assert not any(len(s & own) >= 0.8 * len(s) for s in (decontam.shingles(decontam.words(x)) for x in items) if s)
    packed = p.run(spark, DATA).toPandas()
    assert set(packed.doc_id) == kept[-1]
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_against_brute_force(spark):
    """Which documents reach the end, and every token of theirs, by plain Python and the SQL of the quality rules."""
    import corpus_pipeline as p
    from noticeframe.llm import decontam, pii
    from noticeframe.llm.queries import tokenizer_file
    from tokenizers import Tokenizer

    from .test_near_copies import all_links, components

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLES['op9_quality']}) WHERE kept").fetchall()}
    docs = sorted((d, t or "") for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if d in good)
    same = [" ".join(t.lower().split()) for _, t in docs]
    texts = list(dict.fromkeys(same))
    group = components(len(texts), all_links(texts))
    number = {t: i for i, t in enumerate(texts)}
    first = {}
    for (d, _), t in zip(docs, same):
        first.setdefault(group[number[t]], d)
    items = [decontam.shingles(decontam.words(t or "")) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    clean = [(d, t) for d, t in docs if d in set(first.values()) and not any(i and len(i & decontam.shingles(decontam.words(t))) >= 0.8 * len(i) for i in items)]
    redacted = dict(tuple(r) for r in pii.redact(spark.createDataFrame(clean, "doc_id long, text string")).collect())
    tokens = Tokenizer.from_file(tokenizer_file())
    want = {d: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for d, t in redacted.items()}
    got = p.run(spark, DATA).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want == got.groupby("doc_id").doc_tokens.first().to_dict()
    places = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]) and g.length.sum() <= 1024 for _, g in places)


def test_stages_on_edges(spark, edge_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, through every stage."""
    import corpus_pipeline as p

    folder = f"{spark.sparkContext.getCheckpointDir()}/edge-tables"
    spark.createDataFrame([(1, "never seen words here at all"), (2, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    odd = edge_docs.selectExpr("*", "'x' AS name", "1 AS n_chars", "'y' AS _x", "'z' AS own")
    for df in (odd, odd.limit(0)):
        out = df
        for name, stage in p.STAGES:
            done = stage(spark, df, folder)
            if name != p.STAGES[-1][0]:
                assert done.dtypes == df.dtypes, name
            assert done.count() <= df.count() or name == p.STAGES[-1][0]
            # The rows here are made of numbered words, which the quality rules reject; the other stages are also chained.
            out = stage(spark, out, folder) if name != "quality" else df
        assert (out.count() > 0) == (df is odd)
