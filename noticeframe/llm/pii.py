"""Operator 2: personal data by patterns, checksums and context (native).

Patterns propose spans, checksums (Luhn for cards, mod-97 for IBANs) and value ranges confirm them,
and words near a span move its score. Spans of the four base kinds always stay; spans of the added
kind ``iban`` need a score of ``KEEP_FROM``. The patterns below equal the plain ones of the docstring
of each kind but cannot backtrack over long runs and cannot recurse, so very long texts neither slow
them down nor overflow a stack:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: a leftmost match starts where its run
  of characters starts, or where the last match ended;
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``; card ``[0-9]([ -]?[0-9])+``; phone
  ``\\+[0-9][ ().0-9-]+[0-9]``;
* iban: a country's letters, two digits and as many letters or digits, single blanks between them, as that country's
  numbers have, at word boundaries; so a capital word behind a number is not taken for its end.

Null and empty texts have no spans; repeated rows are scanned each. ``find_spans`` adds the column ``pii``, which takes
the place of a column of that name; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside, whole_text

#: Characters of an international bank account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"\b(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")\b",
}
KINDS = tuple(PATTERNS)
BASE_KINDS = KINDS[:4]
#: Cheap tests that let most texts skip a pattern.
HINTS = {"email": "contains(_t, '@')", "ip": r"_t rlike r'[0-9]\.[0-9]'", "card": "_t rlike '[0-9][ -]?[0-9]'", "phone": "contains(_t, '+')", "iban": "_t rlike '[A-Z]{2}[0-9]{2}'"}
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
MOD97 = "aggregate(split(upper(replace(concat(substr(x.m, 5), substr(x.m, 1, 4)), ' ', '')), ''), 0L, (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> p rlike '^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": f"length({DIGITS}) BETWEEN 14 AND 19 AND luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
    # Spaces are dropped before the four leading characters are moved to the end.
    "iban": MOD97.replace("substr(x.m", "substr(replace(x.m, ' ', '')") + " = 1",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7}
NEAR, RAISE, LOWER, KEEP_FROM = 40, 0.2, 0.4, 0.6
RAISING = r"(?i)(mail|contact|phone|tel|call|card|visa|account|iban|bank|address|server|host)"
LOWERING = r"(?i)(version|isbn|issn|serial|example|sample|build)"
BLOCK = 256


def _starts() -> str:
    """Offsets of the matches: running sum of gap and match lengths, in blocks, so it stays linear."""
    steps = "transform(_g, (g, i) -> length(g) + coalesce(length(get(_m, i - 1)), 0))"
    blocks = f"transform(sequence(0, (size(_m) - 1) div {BLOCK}), b -> slice(_st, b * {BLOCK} + 1, {BLOCK}))"
    return steps, blocks


def _matches(kind: str) -> str:
    """Array of struct(s, e, r, k, m) of one kind: offsets in code points, end exclusive."""
    pattern = PATTERNS[kind]
    empty = "cast(array() AS array<struct<s:int,e:int,m:string>>)"
    # let-bindings through one-element arrays keep each regular expression to a single evaluation
    step, blocks = _starts()
    bound = (
        f"transform(array(regexp_extract_all(_t, r'{pattern}', 0)), _m -> "
        f"transform(array(split(_t, r'{pattern}', -1)), _g -> "
        f"transform(array({step}), _st -> "
        f"transform(array({blocks}), _bl -> "
        "transform(array(aggregate(_bl, array(0), (a, x) -> concat(a, array(element_at(a, -1) + aggregate(x, 0, (p, q) -> p + q))))), _of -> "
        "zip_with(slice(flatten(transform(_bl, (x, b) -> aggregate(x, named_struct('p', get(_of, b), 'o', cast(array() AS array<int>)), (a, v) -> named_struct('p', a.p + v, 'o', concat(a.o, array(a.p + v))), a -> a.o))), 1, size(_m)), _m, (s, m) -> named_struct('s', s, 'e', s + length(m), 'm', m))"
        ")[0])[0])[0])[0])[0]"
    )
    found = f"CASE WHEN {HINTS[kind]} AND regexp_instr(_t, r'{pattern}') > 0 THEN {bound} ELSE {empty} END"
    context = f"concat(substr(_t, greatest(1, x.s + 1 - {NEAR}), least(x.s, {NEAR})), ' ', substr(_t, x.e + 1, {NEAR}))"
    scored = (
        f"transform(filter({found}, x -> {VALID[kind]}), x -> named_struct('s', x.s, 'r', {KINDS.index(kind)}, 'e', x.e, 'k', '{kind}', "
        f"'score', {SCORES[kind]}D + CASE WHEN {context} rlike '{RAISING}' THEN {RAISE}D ELSE 0D END - CASE WHEN {context} rlike '{LOWERING}' THEN {LOWER}D ELSE 0D END))"
    )
    return scored if kind in BASE_KINDS else f"filter({scored}, x -> x.score >= {KEEP_FROM}D)"


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of struct(s, r, e, k, score), by start, then kind as listed."""
    plain, names = set_aside(docs)
    found = plain.select("*", whole_text(names[text]).alias("_t"))
    found = found.select(*names.values(), *[F.expr(_matches(k)).alias(f"_{k}") for k in KINDS])
    spans = F.array_sort(F.concat(*[f"_{k}" for k in KINDS]))
    return found.select(*[F.col(n).alias(c) for c, n in names.items() if c != "pii"], spans.alias("pii"))


def span_text(spans: str) -> str:
    """SQL for ``kind:start:end`` joined by commas."""
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null stays null.

    Overlapping spans are replaced once, under the kind of the first. ``n_chars``, where there is
    such a column, is set to the new length.
    """
    plain, names = set_aside(docs)
    t = names[text]
    merged = "aggregate(pii, cast(array() AS array<struct<s:int,e:int,k:string>>), (a, x) -> CASE WHEN size(a) > 0 AND x.s < element_at(a, -1).e THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(x.e, element_at(a, -1).e), 'k', element_at(a, -1).k))) ELSE concat(a, array(named_struct('s', x.s, 'e', x.e, 'k', x.k))) END)"
    cut = f"concat(array_join(transform(_x, (x, i) -> concat(substr({t}, coalesce(get(_x, i - 1).e, 0) + 1, x.s - coalesce(get(_x, i - 1).e, 0)), '[', upper(x.k), ']')), ''), substr({t}, element_at(_x, -1).e + 1))"
    spans = find_spans(plain, t).select(*names.values(), F.expr(merged).alias("_x"))
    clean = spans.withColumn(t, F.expr(f"CASE WHEN size(_x) = 0 THEN {t} ELSE {cut} END"))
    if "n_chars" in names:
        n = names["n_chars"]
        clean = clean.withColumn(n, F.when(F.col(t).isNull(), F.col(n)).otherwise(F.char_length(t).cast(dict(docs.dtypes)["n_chars"])))
    return clean.select(*[F.col(n).alias(c) for c, n in names.items()])
