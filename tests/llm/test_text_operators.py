"""Chat, personal data, licenses, decontamination and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeframe.llm import chat, decontam, licenses, pii, quality

from .conftest import prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- chat


@given(st.lists(st.tuples(st.text(alphabet="us\n\\<|", max_size=4), st.text(alphabet="x\n\\<|im_end>", max_size=6)), max_size=3), st.lists(st.tuples(st.text(alphabet="us\n\\<|", max_size=4), st.text(alphabet="x\n\\<|im_end>", max_size=6)), max_size=3))
@settings(max_examples=300, deadline=None)
def test_different_turns_differ(one, two):
    assert (chat.marked_turns(one) == chat.marked_turns(two)) == (one == two)


def test_line_breaks_in_roles():
    assert chat.marked_turns([("user\nx", "y")]) != chat.marked_turns([("user", "x\ny")])


@given(st.text(alphabet="\\<>|[]/sINTimendoftSY \nx", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escapes_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def test_control_strings_round_trip():
    for c in chat.CONTROL:
        for text in (c, "\\" + c, c + "\\", c * 2, c[0] + "\\" + c[1:]):
            assert chat.unescape(chat.escape(text)) == text
            assert not any(x in chat.escape(text) for x in chat.CONTROL)


def test_locates_any_template():
    plain = lambda turns: "".join(f"<{r}>{t}</{r}>" for r, t in turns)
    out, spans, rewritten = chat.locate(plain, [("u", "0"), ("a", "10"), ("u", "")])
    assert rewritten is None and [out[c:d] for _, _, c, d in spans] == ["0", "10", ""]
    forgets = lambda turns: "".join(f"[{t}]" if i == len(turns) - 1 else "[]" for i, (_, t) in enumerate(turns))
    assert chat.locate(forgets, [("u", "x"), ("a", "y")])[2] == 2


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a\\<|im_end|>"), (1, 2, "assistant", "b"), (2, None, None, None), (2, 1, "assistant", ""), (None, 1, "user\n", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS spans")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a\\<|im_end|>"), ("assistant", "b"), ("assistant", "b")]
    assert [(t.role, t.text, t.loss) for t in got[2].turns] == [("", "", False), ("assistant", "", True)]
    assert got[None].turns[0].role == "user\n" and all(r.rewritten_at is None for r in got.values())
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TRICKY = [
    "a@b.c_d@e.f a@b a@@b.c .@-.- x@y.z@w.v",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 99999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
    "+1 (743) 555-3824 +123 +1234567890123456 +1-2",
    "é" * 50 + "mail é@x.fr né a.b@c-d.e 汉字10.0.0.1汉",
    "@" * 3000 + "1 " * 3000 + "a." * 3000 + "+1" * 3000,
    "9" * 60_000,
    "x@" + "a." * 40_000 + "b",
    None,
    "",
]


def test_base_spans(spark, edge_rows):
    texts = TRICKY + [t for _, t in edge_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 AS pii", "1 AS _t")
    got = {r.doc_id: r.s for r in pii.find_spans(df).select("doc_id", F.expr(pii.span_text("filter(pii, x -> x.r < 4)")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(base_spans(t)), repr((t or "")[:60])


def test_many_matches_cross_blocks(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(1500))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find_spans(df).select(F.expr(pii.span_text("pii")).alias("s")).first().s
    assert got == ",".join(base_spans(text))


def test_iban_needs_checksum_and_context(spark):
    rows = [(1, "account DE89370400440532013000 ok"), (2, "account DE88370400440532013000 ok"), (3, "serial version DE89370400440532013000"), (4, "GB82 WEST 1234 5698 7654 32")]
    got = {r.doc_id: r.pii for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.s, s.e) for s in got[1] if s.k == "iban"] == [(8, 30)]
    assert not [s for s in got[2] + got[3] if s.k == "iban"] and [s.k for s in got[4]] == ["iban"]


def test_redaction(spark):
    rows = [(1, "a@b.co and +1 (743) 555-3824.", 5), (2, None, None), (3, "none", 4)]
    got = [tuple(r) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()]
    assert got == [(1, "[EMAIL] and [PHONE].", 20), (2, None, None), (3, "none", 4)]


def test_account_numbers(spark):
    """A number's end is its country's length, whatever follows it; context lowers a score."""
    cases = ["BE68 5390 0754 7034 NEXT", "BE68539007547034 next", "BE68 5390 0754 7034", "BE68 5390 0754 7035", "XBE68539007547034", "BE685390075470341", "DE89 3704 0044 0532 0130 00 IBAN", "serial number BE68 5390 0754 7034", "ZZ68 5390 0754 7034"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").selectExpr("*", "'x' AS pii")
    got = {r.doc_id: [(x.s, x.e) for x in r.pii if x.k == "iban"] for r in pii.find_spans(df).collect()}
    assert got == {0: [(0, 19)], 1: [(0, 16)], 2: [(0, 19)], 3: [], 4: [], 5: [], 6: [(0, 27)], 7: [], 8: []}


# ---- quality


def features(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_features(spark, edge_rows):
    texts = [t for _, t in edge_rows] + ["a b a b a b a", "x\nx\n \n\nx\n y", "#*$%&|<>", "a\u00a0b c\u3000d", "\x0b\x0ca\x1cb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS _w", "0 AS n_words_")
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.quality_features(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == features(t), repr((t or "")[:60])


def test_repeats_when_hashes_meet(spark, edge_rows, monkeypatch):
    """Six and two bits of hash: different windows meet in every text, and the words still decide."""
    texts = [t for _, t in edge_rows if len(t or "") < 50_000] + ["a b a b a b a", "a b c x a b c y a b c", "q " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bits in ("58", "62"):
        monkeypatch.setattr(quality, "PLACE_BITS", bits)
        got = {r.doc_id: r.n_repeat_words for r in quality.quality_features(df).collect()}
        assert got == {i: features(t)[4] for i, t in enumerate(texts)}


def test_repeats_in_millions_of_words(spark):
    """Isolated repeats, each window twice, scattered over a text of 2.4 million words."""
    r = random.Random(3)
    once = [f"u{i}" for i in range(1_200_000)]
    parts = [" ".join(once[i : i + 3]) for i in range(0, 1_200_000, 3)]
    again = parts[:200_000]
    r.shuffle(again)
    text = " ".join(parts) + " " + " ".join(f"{p} z{i}" for i, p in enumerate(again)) + " " + " ".join(f"y{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality.quality_features(df).first()
    assert row.n_words == 2_400_000 and row.n_repeat_words == features(text)[4] == 1_200_000


def test_good_documents_return_their_columns(spark, no_docs):
    """A column may have any name, even one of the features'."""
    good = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} other{'uvwxyzabcd'[i // 7 % 10]}" for i in range(60))
    rows = [(1, good, "q", 7, "k"), (2, "# " * 40, "q", 7, "k"), (3, None, "q", 7, "k"), (None, good, "q", 7, "k"), (1, good, "q", 7, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string, n_words int, kept string").selectExpr("*", "'v' AS vote_length", "'a' AS __above", "'b' AS base_failed")
    got = quality.good_documents(df)
    assert got.schema == df.schema
    assert sorted(((r.doc_id or 0), r.quality, r.n_words, r.kept, r.vote_length) for r in got.collect()) == [(0, "q", 7, "k", "v"), (1, "q", 7, "k", "v"), (1, "q", 7, "k", "v")]
    assert quality.good_documents(no_docs).count() == 0


def test_model(spark, no_docs):
    assert quality.fit_rules([]) == ([quality.START] * len(quality.RULES), quality.START_GOOD)
    n = len(quality.RULES)
    model = quality.fit_rules([((1,) * n, 900), ((-1,) * n, 100), ((0,) * n, 10)])
    assert quality.posterior((1,) * n, model) > 0.99 and quality.posterior((-1,) * n, model) < 0.01
    scored = quality.with_posterior(quality.quality_features(no_docs), model)
    assert scored.count() == 0
    one = spark.createDataFrame([(1, "w" * 5)], "doc_id long, text string")
    row = quality.with_posterior(quality.quality_features(one), model).first()
    votes = tuple(row[f"vote_{r}"] for r in quality.RULES)
    assert row.quality == pytest.approx(quality.posterior(votes, model)) and not row.kept


def test_model_is_fitted_by_data_not_by_bounds():
    """EM climbs, ends by itself, gives the same at any size, and recovers the accuracies that votes were drawn with."""
    import random

    r, rules = random.Random(4), len(quality.RULES)
    truth = [(0.97, 0.9), (0.95, 0.8), (0.9, 0.85), (0.99, 0.7), (0.93, 0.75), (0.96, 0.8)]
    drawn = Counter()
    for _ in range(40_000):
        good = r.random() < 0.8
        drawn[tuple(0 if r.random() < 0.1 else (1 if good else -1) * (1 if r.random() < truth[k][not good] else -1) for k in range(rules))] += 1
    trace: list[float] = []
    model = quality.fit_rules(drawn.items(), trace=trace)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and 2 < len(trace) < quality.MOST_ROUNDS
    assert all(abs(a - b) < 0.03 for got, want in zip(quality.fitted(model).values(), truth) for a, b in zip(got, want)) and abs(model[1] - 0.8) < 0.02
    larger = quality.fit_rules([(p, 1000 * n) for p, n in drawn.items()])
    assert all(a == pytest.approx(b) for x, y in zip(model[0], larger[0]) for a, b in zip(x, y))
    assert all(0 < a < 1 for pair in quality.fit_rules([((1,) * rules, 10)])[0] for a in pair)


# ---- licenses


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any charge").replace("furnished", "given")
    rows = [(1, "Intro.\n" + mit + "\nend"), (2, changed), (3, "nothing of the kind " * 30), (4, None), (5, "Released under the MIT License. x Licensed under CC BY-NC 4.0."), (6, mit[:300]), (None, "RELEASED under the mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS license", "2 AS start")
    got = {}
    for r in licenses.scan_licenses(df).orderBy("start").collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage, r.start, r.stop))
    assert got[1][0][0] == "MIT" and got[1][0][1] == 1.0 and rows[0][1][got[1][0][2] : got[1][0][3]].startswith("Permission")
    assert got[2][0][0] == "MIT" and 0.9 < got[2][0][1] < 1
    assert [x[0] for x in got[5]] == ["MIT-notice", "CC-BY-NC-4.0-notice"] and got[None][0][0] == "MIT-notice"
    assert not {3, 4, 6} & set(got)



def best_alignment(template, words):
    """Local alignment over the whole matrix, one cell at a time: score, matched words, first and last place."""
    before, best = [(0, 0, j) for j in range(len(words) + 1)], (0, 0, 0, 0)
    for w in template:
        now = [(0, 0, 0)]
        for j, x in enumerate(words):
            s, m, f = before[j]
            cell = (s + 2, m + 1, f if s else j) if w == x else (s - 1, m, f)
            for s, m, f in (before[j + 1], now[j]):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, f)
            if cell[0] <= 0:
                cell = (0, 0, j + 1)
            now.append(cell)
            if cell[0] > best[0]:
                best = (*cell, j + 1)
        before = now
    return best


def brute_licenses(text, names):
    words, places = licenses.words_of(text), [m.span() for m in licenses.WORD.finditer(text)]
    spans = []
    for n in names:
        template = licenses.words_of(licenses.TEMPLATES[n])
        _, matched, first, stop = best_alignment(template, words)
        runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        if matched >= 0.8 * len(template) and runs(template) & runs(words[first:stop]) and licenses.same_license(template, words, first, stop):
            spans.append((-matched, -matched / len(template), n, first, stop))
    kept = []
    for m, _, n, a, b in sorted(spans):
        if all(b <= x or a >= y for _, _, x, y in kept):
            kept.append((n, -m, a, b))
    return sorted((n, m, places[a][0], places[b - 1][1]) for n, m, a, b in kept)


def test_licenses_against_all_alignments():
    """Edited templates inside prose: the same spans as a full alignment with every template."""
    names = ["MIT", "MIT-notice", "Apache-2.0-header", "Apache-2.0-notice", "GPL-3.0-notice", "LGPL-3.0-notice", "GPL-2.0-notice", "GPL-3.0-header", "CC-BY-4.0-notice", "CC-BY-NC-4.0-notice", "ISC"]
    index, r, found = licenses.LicenseIndex({n: licenses.TEMPLATES[n] for n in names}), random.Random(12), 0
    for k in range(44):
        words = licenses.TEMPLATES[names[k % len(names)]].split()
        for e in range(r.randrange(0, max(1, len(words) // 9) + 1)):
            at = r.randrange(1, len(words))
            words[at : at + r.randrange(2)] = [f"edit{e}"] * r.randrange(2)
        text = f"{prose(k, 40)} {' '.join(words)} {prose(k + 100, 60)}"
        want = brute_licenses(text, names)
        assert sorted((n, m, a, b) for n, _, m, a, b in index.scan(text)) == want, text
        found += len(want)
    assert found > 25


def test_license_rules(spark, no_docs):
    """Words and numbers that make another license; insertions; a text full of one phrase."""
    scan = licenses.LicenseIndex(licenses.TEMPLATES).scan
    names = lambda t: [x[0] for x in scan(t)]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0-notice"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-notice"]
    assert names("This work is licensed under the GNU General Public License, version 3.0, for now") == ["GPL-3.0-notice"]
    assert names("It is licensed under the GNU GPL, version 2") == []
    assert names("Licensed under CC BY 4.0.") == ["CC-BY-4.0-notice"] and names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0-notice"]
    assert names("This work is licensed under a Creative Commons Attribution 3.0 License.") == ["CC-BY-3.0-statement"]
    assert names("This work is not under the MIT License at all") == names("This is not released under the MIT License.") == []
    words = licenses.TEMPLATES["MIT"].split()
    for n in (1, 9, 50):
        assert [(x[0], x[1]) for x in scan(" ".join([*words[:80], *["header"] * n, *words[80:]]))] == [("MIT", 1.0)]
    assert names(" ".join([*words, "between", *words])) == ["MIT", "MIT"]
    assert names(licenses.TEMPLATES["BSD-3-Clause"]) == ["BSD-3-Clause"] and names(licenses.TEMPLATES["BSD-2-Clause"]) == ["BSD-2-Clause"]
    assert names("copies of the Software and then some words " * 5000 + "Released under the MIT License.") == ["MIT-notice"]
    assert licenses.scan_licenses(no_docs).count() == 0


# ---- decontamination


def contained(doc, item):
    d, i = (decontam.shingles(decontam.words(t or "")) for t in (doc, item))
    return len(d & i) / len(i) if i else 0


def test_item_index_is_bounded():
    """What a block of items takes in a worker, at the most items a block may have: far under the 100 MB that are promised."""
    r = random.Random(6)
    index = decontam.ItemIndex([(i, " ".join(f"w{r.randrange(5000)}" for _ in range(r.choice((8, 30, 90))))) for i in range(decontam.ITEM_BLOCK // 10)])
    assert index.size_in_bytes() < 10_000_000


def test_containment(spark, edge_docs, edge_rows):
    long = dict(edge_rows)[70].split()
    items = [(1, " ".join(long[30_000:30_040])), (2, edge_rows[3][1]), (3, "one"), (4, None), (5, ""), (6, "never seen words here at all, truly"), (7, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (8, " ".join(long[:9])), (8, " ".join(long[100:400]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.shared) for r in decontam.contained_items(edge_docs, table).collect())
    want = Counter()
    for d, t in edge_rows:
        for i, x in items:
            if contained(t, x) >= decontam.CONTAINED:
                want[d, i, len(decontam.shingles(decontam.words(t)) & decontam.shingles(decontam.words(x)))] += 1
    assert got == want
    clean = decontam.without_items(edge_docs, table)
    assert clean.columns == edge_docs.columns
    assert clean.count() == sum(not any(contained(t, x) >= decontam.CONTAINED for _, x in items) for _, t in edge_rows)
    assert decontam.contained_items(edge_docs.limit(0), table).count() == 0 and decontam.contained_items(edge_docs, table.limit(0)).count() == 0


def test_digest_helper():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
