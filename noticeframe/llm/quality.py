"""Operator 9: weak supervision over quality rules (native).

Every rule votes good (1), bad (-1) or abstains (0). Documents are counted by their pattern of
votes: with ``len(RULES)`` rules there are at most ``3 ** len(RULES)`` patterns, however many
documents there are, so the pattern counts are a bounded table. Expectation-maximisation over those
counts estimates each rule's accuracy on good and on bad documents and the share of good ones. The posterior probability of
a document is then an arithmetic expression of its votes, evaluated in the scan.

Null texts count as empty (no words, every count 0, base rule failed). An empty table gives no rows
and the starting accuracies. Repeated rows count as often as they occur. Other columns pass through
``quality_features`` and ``with_posterior`` untouched, except that a column with the name of one of theirs gives way to
it; ``good_documents`` returns every column as it came.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, set_aside, whole_text, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Votes as SQL over the features; the same text serves Spark and the DuckDB check.
RULES = {
    "length": "CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN -1 WHEN word_chars >= 3 * n_words AND word_chars <= 7 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 50 * n_symbols <= n_words THEN 1 ELSE 0 END",
    "letters": "CASE WHEN 10 * n_letters < 8 * word_chars THEN -1 WHEN 10 * n_letters >= 9 * word_chars THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN 4 * n_repeat_words > n_words THEN -1 WHEN 20 * n_repeat_words <= n_words THEN 1 ELSE 0 END",
    "case": "CASE WHEN 10 * n_upper > 3 * word_chars THEN -1 WHEN 20 * n_upper <= 3 * word_chars THEN 1 ELSE 0 END",
}
#: Prior accuracy of a rule on good and on bad documents it votes on, and prior share of good ones. Each counts as much as ``PRIOR`` of
#: the documents, so no accuracy is ever 0 or 1, and a corpus of any size is judged alike.
START, START_GOOD, PRIOR = (0.95, 0.4), 0.8, 0.003
#: EM ends when a round adds less than this to the log-posterior per document, or after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-9, 300
KEEP_FROM = 0.5
#: Bits of a window's sort key that hold its place; the hash has the others.
PLACE_BITS = "length(bin(size(_w)))"


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, three further counts and one vote column per rule."""
    aside, names = set_aside(docs)
    plain = aside.select("*", whole_text(names[text]).alias("_t"))
    split = plain.select("*", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n", -1).alias("_l"))
    lines = f"filter(_l, x -> btrim(x, '{SPACES}') <> '')"
    # A window's hash above its place, so that one primitive sort brings windows of equal hash together; the place
    # takes the bits it needs. Windows next to each other with the same hash are then held against each other, word by
    # word. Where two of them differ, that text's windows are sorted by their words instead: the words decide always.
    windows = "sort_array(CASE WHEN size(_w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 3), i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _b) | cast(i AS bigint)) END)"
    sized = split.select("*", F.expr(PLACE_BITS).alias("_b"), F.expr(lines).alias("_ll"))
    sorted_ = sized.select("*", F.expr(windows).alias("_s"))
    alike = "coalesce(shiftright(x, _b) = shiftright(get(_s, i + 1), _b), false) OR coalesce(shiftright(x, _b) = shiftright(get(_s, i - 1), _b), false)"
    met = sorted_.select("*", F.expr(f"filter(_s, (x, i) -> {alike})").alias("_c")).drop("_s")
    place = "cast({} & (shiftleft(1L, _b) - 1) AS int)"
    x, y = place.format("get(_c, j)"), place.format("get(_c, j - 1)")
    differ = " OR ".join(f"get(_w, {k} + {x}) <> get(_w, {k} + {y})" for k in range(3))
    mixed = f"size(_c) > 1 AND exists(sequence(1, greatest(1, size(_c) - 1)), j -> shiftright(get(_c, j), _b) = shiftright(get(_c, j - 1), _b) AND ({differ}))"
    in_words = "sort_array(transform(sequence(0, size(_w) - 3), i -> named_struct('a', get(_w, i), 'b', get(_w, i + 1), 'c', get(_w, i + 2), 'i', i)))"
    equal = lambda o: f"coalesce(e.a = {o}.a AND e.b = {o}.b AND e.c = {o}.c, false)"
    by_words = f"transform(filter(_e, (e, j) -> {equal('get(_e, j - 1)')} OR {equal('get(_e, j + 1)')}), e -> e.i)"
    judged = met.select("*", F.expr(f"CASE WHEN {mixed} THEN {in_words} END").alias("_e"))
    twice = judged.select("*", F.expr(f"sort_array(CASE WHEN _e IS NULL THEN transform(_c, x -> {place.format('x')}) ELSE {by_words} END)").alias("_r"))
    covered = "cast(aggregate(_r, named_struct('n', 0, 'end', 0), (a, x) -> named_struct('n', a.n + x + 3 - greatest(a.end, x), 'end', x + 3), a -> a.n) AS bigint)"
    own = {
        "n_words": "cast(size(_w) AS bigint)",
        "word_chars": "cast(length(array_join(_w, '')) AS bigint)",
        "n_symbols": "cast(length(_t) - length(regexp_replace(_t, '[#*$%&|<>]', '')) AS bigint)",
        "n_dup_lines": "cast(size(_ll) - size(array_distinct(_ll)) AS bigint)",
        "n_repeat_words": covered,
        "n_letters": "cast(length(regexp_replace(array_join(_w, ''), '[^\\\\p{L}]+', '')) AS bigint)",
        "n_upper": "cast(length(_t) - length(regexp_replace(_t, '[A-Z]', '')) AS bigint)",
    }
    counted = twice.select(*[F.col(n).alias(c) for c, n in names.items() if c not in own], *[F.expr(e).alias(c) for c, e in own.items()])
    return counted.select("*", *[F.expr(e).alias(f"vote_{r}") for r, e in RULES.items()]).withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    )


Model = tuple[list[tuple[float, float]], float]


def fit_rules(patterns: Iterable[tuple[tuple[int, ...], int]], most_rounds: int = MOST_ROUNDS, trace: list[float] | None = None) -> Model:
    """Accuracy of each rule on good and on bad documents, and the share of good ones, by EM over pattern counts.

    The log-posterior of each round goes to ``trace``; it never falls.
    """
    rows = sorted(patterns)
    accuracy, good = [START] * len(RULES), START_GOOD
    total = sum(n for _, n in rows)
    held, before = PRIOR * total, None
    for _ in range(most_rounds if total else 0):
        right, cast, share = [[held * x for x in START] for _ in RULES], [[held, held] for _ in RULES], held * START_GOOD
        # Of the prior first, then of each pattern.
        likely = held * (START_GOOD * math.log(good) + (1 - START_GOOD) * math.log(1 - good))
        likely += held * sum(x * math.log(a) + (1 - x) * math.log(1 - a) for pair in accuracy for x, a in zip(START, pair))
        prior, each = math.log(good / (1 - good)), weights((accuracy, good))[1]
        for votes, n in rows:
            odds = prior + sum(w[v < 0] for v, w in zip(votes, each) if v)
            of_bad = math.log(1 - good) + sum(math.log(b if v < 0 else 1 - b) for v, (_, b) in zip(votes, accuracy) if v)
            likely += n * (of_bad + max(odds, 0) + math.log1p(math.exp(-abs(odds))))
            p = 1 / (1 + math.exp(-odds))
            share += n * p
            for k, v in enumerate(votes):
                if v:
                    for c, weight in enumerate((n * p, n * (1 - p))):
                        cast[k][c] += weight
                        right[k][c] += weight * (v == (1, -1)[c])
        accuracy = [tuple(r[c] / n[c] for c in (0, 1)) for r, n in zip(right, cast)]
        good = share / (total + held)
        if trace is not None:
            trace.append(likely)
        if before is not None and likely - before < TOLERANCE * total:
            break
        before = likely
    return accuracy, good


def fitted(model: Model) -> dict[str, tuple[float, float]]:
    """The accuracies by rule, on good and on bad documents."""
    return dict(zip(RULES, model[0]))


def weights(model: Model) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds for good: of the prior, and of each rule's good and bad vote."""
    accuracy, good = model
    return math.log(good / (1 - good)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in accuracy]


def posterior(votes: tuple[int, ...], model: Model) -> float:
    prior, each = weights(model)
    return 1 / (1 + math.exp(-(prior + sum(w[v < 0] for v, w in zip(votes, each) if v))))


def pattern_counts(features: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Counts over all documents by pattern of votes: at most 3 ** len(RULES) rows."""
    votes = [f"vote_{r}" for r in RULES]
    return [(tuple(row[:-1]), row[-1]) for row in features.groupBy(*votes).count().collect()]


def with_posterior(features: DataFrame, model: Model) -> DataFrame:
    """``features`` with the posterior ``quality`` and the verdict ``kept``."""
    prior, each = weights(model)
    odds = F.lit(prior)
    for rule, (plus, minus) in zip(RULES, each):
        odds = odds + F.when(F.col(f"vote_{rule}") > 0, F.lit(plus)).when(F.col(f"vote_{rule}") < 0, F.lit(minus)).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-odds))
    return features.withColumn("quality", p).withColumn("kept", ~F.col("base_failed") & (p >= KEEP_FROM))


def good_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, every column as it came, whatever its name.

    The counts of vote patterns come from all documents; then each is judged in a second scan. Writing the documents with
    their votes in between would cost their size in disk until the next stage is done.
    """
    aside, names = set_aside(docs)
    features = quality_features(aside, names[text])
    model = fit_rules(pattern_counts(features))
    # A filter that depends on a row number stays above the features, whose long expressions it would repeat below.
    judged = with_posterior(features.withColumn("_above", F.monotonically_increasing_id()), model)
    return judged.withColumn("kept", F.col("kept") & (F.col("_above") >= 0)).where("kept").select(*names.values()).toDF(*docs.columns)
