"""Registered queries that have no SQL, against plain Python over the whole test tables."""

import hashlib
import os
import re
import struct
from html.parser import HTMLParser

import pytest

from noticeframe.catalog import QUERIES
from noticeframe.operators.extract import CLAUSES, NEGATION, OPINION_RULES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


class Words(HTMLParser):
    """The words of a page outside of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.mute, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style")
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)


def test_html_text(spark):
    got = {r.page_id: r.text for r in QUERIES["html_text"](spark, DATA).collect()}
    pages = rows_of(spark, "pages")
    assert len(got) == len(pages) > 0
    for r in pages:
        walk = Words()
        walk.feed(r.html or "")
        walk.close()
        assert (got[r.page_id] or "").split() == "".join(walk.parts).split()


def test_rum_sample(spark):
    import xxhash

    hashed = lambda n: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", n), 42)))[0] % 100
    want = {r.event_id for r in rows_of(spark, "events") if r.event_type == "error" or hashed(r.user_id) < 20}
    assert {r.event_id for r in QUERIES["rum_sample"](spark, DATA).collect()} == want


def test_evidence_dedup(spark):
    taken, kept = {}, set()
    for r in sorted(rows_of(spark, "documents"), key=lambda r: r.doc_id):
        digest = lambda t: hashlib.md5(t.encode()).hexdigest()
        keys = {("url", digest((r.text or "").lower())), ("fp", digest(r.text or "")), ("id", r.doc_id)}
        seen = taken.setdefault(r.source, set())
        if not keys & seen:
            seen |= keys
            kept.add(r.doc_id)
    assert {r.doc_id for r in QUERIES["evidence_dedup"](spark, DATA).collect()} == kept


def test_opinion_signals(spark):
    rules = [*OPINION_RULES, ("growth", 1, "the"), ("growth", -1, "leaux")]
    want = []
    for r in rows_of(spark, "conversations"):
        found = []
        for clause in (c.strip() for c in re.split(CLAUSES, r.text or "")) if r.role == "user" else ():
            for dimension, polarity, words in rules:
                m = re.search(words, clause)
                if m and not re.search(NEGATION, clause[: m.start()]):
                    found.append((r.conv_id, r.turn, dimension, polarity, clause[:60]))
        want += found[:4]
    assert sorted(map(tuple, QUERIES["opinion_signals"](spark, DATA).collect())) == sorted(want)
