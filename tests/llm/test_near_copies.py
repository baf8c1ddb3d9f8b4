"""The wider search for near copies against all pairs of shingle sets: what it links is similar, and it finds nine in ten of what is."""

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noticeframe.llm import nearcopies

from .conftest import prose


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_families(spark):
    r = random.Random(9)
    rows, family = [], {}
    for f in range(12):
        base = prose(1000 + f, 300, 5000).split()
        for k in range(6):
            words = list(base)
            for _ in range(0 if k == 0 else r.randrange(1, 6)):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            family[len(rows) - 1] = f
    rows += [(1000 + i, prose(5000 + i, 300, 5000)) for i in range(60)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in nearcopies.near_copy_groups(df).collect()}
    assert all(got[1000 + i] == 1000 + i for i in range(60)) and got[2001] == 2000
    texts = dict(rows)
    close = [(a, b) for a in family for b in family if a < b and family[a] == family[b] and similarity(texts[a], texts[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in close) >= 0.9 * len(close) > 0
    assert all(family[a] == family[got[a]] for a in family)


def test_large_families(spark):
    """Independently edited copies are similar to their base, seldom to one another: all meet in it."""
    r = random.Random(4)
    rows, family = [], {}
    for f in range(2):
        base = prose(7000 + f, 320, 5000).split()
        for k in range(301):
            words = list(base)
            for at in r.sample(range(0, len(words), 10), 6 if k else 0):
                words[at] = f"edit{r.randrange(10**6)}"
            rows.append((1000 * f + (k - 150) % 301, " ".join(words)))
            family[rows[-1][0]] = f
    texts = dict(rows)
    assert all(similarity(texts[1000 * family[i] + 151], texts[i]) >= 0.82 for i in family)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in nearcopies.near_copy_groups(df).collect()}
    sizes = {}
    for i, c in got.items():
        sizes[c] = sizes.get(c, 0) + 1
    assert all(family[i] == family[c] for i, c in got.items())
    assert sum(sorted(sizes.values())[-2:]) >= 0.95 * len(got), sorted(sizes.values())


def all_links(texts):
    """Every pair of different texts with a similarity of 0.8 or more: those that share one of their rarest fifth of shingles, all compared."""
    sets = [shingles(t) if t.split() else set() for t in texts]
    often = Counter(x for s in sets for x in s)
    table, found = defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        rare = sorted(sets[i], key=lambda x: (often[x], x))[: len(sets[i]) // 5 + 1]
        for j in {j for x in rare for j in table[x]}:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                found.append((i, j))
        for x in rare:
            table[x].append(i)
    return found


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_recall_on_documents(spark):
    """Recall at 0.8 over whole documents, and no group beyond those of all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, " ".join((r.text or "").lower().split())) for r in df.select("doc_id", "text").collect())
    texts = list(dict.fromkeys(t for _, t in rows))
    number = {t: i for i, t in enumerate(texts)}
    links = all_links(texts)
    want = components(len(texts), links)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(df).collect()}
    by_text = {number[t]: got[d] for d, t in rows}
    assert links and sum(by_text[a] == by_text[b] for a, b in links) >= 0.9 * len(links)
    group = {}
    for i, c in by_text.items():
        assert group.setdefault(c, want[i]) == want[i]
    assert all(got[d] == by_text[number[t]] for d, t in rows)


def member(spark, rows):
    """``(k, node, pop, n, bits)`` with the first word of bits given."""
    df = spark.createDataFrame(rows, "k long, node long, pop long, n long, bits0 long, c long")
    return df.select("*", *[F.lit(0).cast("long").alias(b) for b in nearcopies.BITS[1:]])


def test_no_pair_of_a_key_goes_uncompared(spark):
    """Sixty members of one key far from each other, of which only two are near, and those of one component."""
    for one, two in ((0, 59), (17, 42), (58, 59)):
        rows = [(1, i, i, 50, 0, i) for i in range(60)]
        df = member(spark, rows).withColumn("bits0", F.lit(0).cast("long"))
        for b in nearcopies.BITS:
            df = df.withColumn(b, F.when(F.col("node").isin(one, two), F.lit(7)).otherwise(F.xxhash64("node", F.lit(b))))
        df = df.withColumn("keys", F.array(F.lit(1), F.lit(2))).unionByName(df.withColumn("k", F.lit(2)).withColumn("keys", F.array(F.lit(1), F.lit(2))))
        assert [tuple(x) for x in nearcopies.remaining(df).collect()] == [(one, two)]
        assert nearcopies.remaining(df.withColumn("c", F.lit(1))).count() == 0


def test_edges(spark, edge_docs, no_docs):
    """Nulls, empty texts, repeated rows, shared ids and clashing columns."""
    got = nearcopies.one_of_each(edge_docs)
    assert got.columns == edge_docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    ids = Counter(d for d, _ in rows)
    assert ids[3] == 1 and not {60, 61, 62, 63, 41, 42, 71} & set(ids) and ids[40] == 1 and ids[None] == 2
    assert ids[43] == ids[44] == ids[70] == 1 and all(ids[50 + i] == 1 for i in range(6))
    assert nearcopies.one_of_each(no_docs).count() == 0
    versions = spark.createDataFrame([(5, "a b c d e f"), (5, "u v w x y z"), (9, "u v w x y z"), (9, "p q r s t u")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(versions).collect()) == [5, 9]
    odd = edge_docs.selectExpr("*", "1 AS __copy", "2 AS name", "3 AS words0", "4 AS node", "5 AS rows")
    assert nearcopies.one_of_each(odd).columns == odd.columns
