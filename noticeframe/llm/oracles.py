"""DuckDB SQL for the queries that SQL can express, written from the contracts with plain patterns."""

from __future__ import annotations

import re

from . import chat, clustering, pii, quality, warc

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": pii.PATTERNS["iban"],
}


#: Rounds of EM in SQL, which has no end by convergence: verdicts stand long before.
EM_ROUNDS = 40


def _pii() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, t, {r} AS r, '{k}' AS k, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d"
        for r, (k, p) in enumerate(_PLAIN.items())
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT doc_id, t, r, k, ms[i] AS m,
             list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0)),
g AS (SELECT *, s + length(m) AS en, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS c,
             substring(t, CAST(greatest(1, s + 1 - 40) AS BIGINT), CAST(least(s, 40) AS BIGINT)) || ' ' || substring(t, CAST(s + length(m) + 1 AS BIGINT), 40) AS near FROM e),
v AS (SELECT * FROM g WHERE CASE k
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
        WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i:
             CASE WHEN (length(dg) - i) % 2 = 0 THEN CAST(dg[i] AS INT) ELSE CAST(dg[i] AS INT) * 2 - CASE WHEN CAST(dg[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15
        ELSE list_reduce(list_prepend(0, list_transform(string_split(substring(c, 5) || c[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)),
             lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1
             AND NOT regexp_matches(near, '{pii.LOWERING}') END),
a AS (SELECT doc_id, count(*) FILTER (k = 'email') AS n_email, count(*) FILTER (k = 'ip') AS n_ip, count(*) FILTER (k = 'card') AS n_card,
             count(*) FILTER (k = 'phone') AS n_phone, count(*) FILTER (k = 'iban') AS n_iban,
             string_agg(k || ':' || CAST(s AS BIGINT) || ':' || CAST(en AS BIGINT), ',' ORDER BY s, r) FILTER (k <> 'iban') AS base,
             string_agg(k || ':' || CAST(s AS BIGINT) || ':' || CAST(en AS BIGINT), ',' ORDER BY s, r) AS spans
      FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_iban, 0) AS n_iban
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _quality() -> str:
    votes = [f"vote_{r}" for r in quality.RULES]
    cast = ", ".join(f"{e} AS {v}" for v, e in zip(votes, quality.RULES.values()))
    g0, b0 = quality.START
    rounds = [f"m0 AS (SELECT {', '.join(f'{g0}::DOUBLE AS g{k}, {b0}::DOUBLE AS b{k}' for k in range(len(votes)))}, {quality.START_GOOD}::DOUBLE AS good)"]
    odds = "ln(good / (1 - good))" + "".join(f" + CASE WHEN {v} > 0 THEN ln(g{k} / (1 - b{k})) WHEN {v} < 0 THEN ln((1 - g{k}) / b{k}) ELSE 0 END" for k, v in enumerate(votes))
    for n in range(1, EM_ROUNDS + 1):
        rounds.append(f"e{n} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds}))) AS post FROM p, m{n - 1})")
        held = f"{quality.PRIOR} * sum(n)"
        rate = lambda v, sign, w, c: f"({held} * {quality.START[c]} + coalesce(sum(n * {w}) FILTER ({v} {sign} 0), 0)) / ({held} + coalesce(sum(n * {w}) FILTER ({v} <> 0), 0))"
        rates = ", ".join(f"{rate(v, '>', 'post', 0)} AS g{k}, {rate(v, '<', '(1 - post)', 1)} AS b{k}" for k, v in enumerate(votes))
        rounds.append(f"m{n} AS MATERIALIZED (SELECT {rates}, ({held} * {quality.START_GOOD} + sum(n * post)) / (sum(n) + {held}) AS good FROM e{n})")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ll FROM d),
tri AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT row_id, count(DISTINCT i + o) AS n FROM tri, (VALUES (0), (1), (2)) AS x(o) WHERE c > 1 GROUP BY row_id),
f AS (SELECT l.row_id, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ll) - len(list_distinct(ll)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
      FROM l LEFT JOIN rep ON l.row_id = rep.row_id),
v AS (SELECT *, {cast}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
p AS MATERIALIZED (SELECT {', '.join(votes)}, count(*) AS n FROM v GROUP BY ALL),
{', '.join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {quality.KEEP_FROM} AS kept
FROM v, m{EM_ROUNDS}"""


def _chat() -> str:
    control = "|".join(f"(?:{re.escape(c)})" for c in chat.CONTROL)
    escaped = rf"regexp_replace(replace({{}}, '\', '\\'), '({control})', '#\1', 'g')"
    marks = len(chat.START) + len(chat.STOP) + 2
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum({marks} + length({escaped.format('r')}) + length(r) - length(replace(r, chr(10), '')) + length({escaped.format('t')})) AS BIGINT) AS formatted_chars,
       false AS rewrites_history
FROM t GROUP BY conv_id"""


def _warc() -> str:
    tracking = ", ".join(f"'{k}'" for k in warc.TRACKING)
    return rf"""
WITH v AS (SELECT page_id AS p, n, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS sum, CASE WHEN n < 3 OR (n = 5 AND page_id % 4 = 0) THEN '1' ELSE '2' END AS ver
           FROM pages, range(6) AS x(n) WHERE NOT (n = 0 AND page_id % 5 = 0) AND NOT (n = 3 AND page_id % 5 = 1)),
r AS (SELECT *, 8 * p + n AS id, 10 * n + p % 7 AS ts, CASE WHEN p % 3 <> 0 THEN sum || '-' || ver END AS tag, 'Mon, 0' || ver || ' Jan 2024 00:00:00 GMT' AS dated, regexp_replace(url, '#.*$', '') AS b FROM v),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN url WHEN 1 THEN b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'utm_source=v' || n ELSE regexp_replace(url, '^http://', 'https://') END AS asked FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(asked), '#.*$', ''), '^(http://[^/?]*):80([/?]|$)', '\1\2', 'i'), '^(https://[^/?]*):443([/?]|$)', '\1\2', 'i'), '^https?://', '', 'i') AS u FROM w),
q AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND regexp_extract(x, '^([^=]*)', 1) NOT IN ({tracking}))) AS args FROM c),
k AS (SELECT *, path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key, CAST(ts AS HUGEINT) * 1000000000000 + id AS pos FROM q),
j AS (SELECT s.id, s.url_key, s.ts, s.tag, s.dated, o.id AS oid, o.n AS o_n, o.html AS o_html, o.tag AS o_tag, o.dated AS o_dated,
             CASE WHEN s.tag IS NOT NULL AND o.tag IS NOT NULL THEN s.tag = o.tag ELSE s.dated = o.dated END AS same
      FROM (SELECT * FROM k WHERE n NOT IN (0, 3)) AS s ASOF LEFT JOIN (SELECT * FROM k WHERE n IN (0, 3)) AS o ON s.url_key = o.url_key AND s.pos > o.pos)
SELECT id AS record_id, url_key, CASE WHEN oid IS NULL THEN 'missing' WHEN same THEN 'resolved' ELSE 'changed' END AS status, oid AS original_id,
       CASE WHEN oid IS NOT NULL AND same THEN sha256(o_html || CASE o_n WHEN 3 THEN '<!-- 2 -->' ELSE '' END) END AS payload_sha256,
       CASE WHEN oid IS NOT NULL AND same THEN 'cache-control: max-age=' || o_n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'last-modified: ' || o_dated || chr(10) || 'vary: accept'
            ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'vary: accept' END AS headers
FROM j"""


def _interactions() -> str:
    """Every step of every order by itself, from the documents grouped by the letters they fail."""
    letters = "ABCDE"
    picks = ", ".join(f"l AS l{i}" for i in range(5))
    apart = " AND ".join(f"l{i}.x <> l{j}.x" for i in range(5) for j in range(i))
    lost = ", ".join(f"CAST(coalesce(sum({c}) FILTER (here), 0) AS BIGINT) AS {n}" for c, n in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost")))
    return rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(string_split('{letters}', '')) AS x),
o AS (SELECT {' || '.join(f'l{i}.x' for i in range(5))} AS filter_order FROM {picks} WHERE {apart}),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substring(filter_order, step, 1) AS x, string_split(substring(filter_order, 1, step - 1), '') AS before FROM o, range(1, 6) AS r(step)),
c AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS bad, fails = x AS only_x, len(list_filter(before, lambda b: b <> '' AND contains(fails, b))) > 0 AS gone, bad AND NOT gone AS here FROM g, s),
a AS (SELECT part, filter_order, step, x, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0) AS BIGINT) AS kept, {lost}, CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (only_x), 0) AS BIGINT) AS unique_fails FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM a"""


def _clustering() -> str:
    """All distances in every round."""
    k, dims = clustering.CENTROIDS, clustering.DIMS
    rounds = []
    for n in range(clustering.ROUNDS + 1):
        rounds.append(f"a{n} AS MATERIALIZED (SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT id, c, list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, m{n}) GROUP BY id)")
        if n < clustering.ROUNDS:
            rounds.append(
                f"s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS k FROM a{n} JOIN v USING (id), range(1, {dims + 1}) AS r(i) GROUP BY c, i)"
            )
            rounds.append(
                f"m{n + 1} AS MATERIALIZED (SELECT m.c, coalesce(x.u, m.u) AS u FROM m{n} AS m LEFT JOIN (SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS u FROM s{n} GROUP BY c) AS x USING (c))"
            )
    last = clustering.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS u FROM (SELECT v, sha256('{clustering.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {k})),
{', '.join(rounds)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256
FROM a{last} AS a JOIN v USING (id) JOIN m{last} AS m ON a.c = m.c"""


ORACLES: dict[str, str] = {
    "op1_chat": _chat(), "op2_pii": _pii(), "op8_warc": _warc(), "op9_quality": _quality(), "op11_interactions": _interactions(), "op13_clustering": _clustering(),
}
