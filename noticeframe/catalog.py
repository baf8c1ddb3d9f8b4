"""Registered queries of the library over the star-schema tables, each with the SQL it must equal.

The recruitment vocabulary maps to the tables: notices are orders, employers customers, cities nations,
positions line items, change logs and user state events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import facts, text, timeutil
from .operators import audit, calendar, collection, entity, relational, reputation, state
from .plans import flat_query
from .plans.params import Query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TODAY = "1998-06-01"
def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


NOW, EVENT_NOW = "1998-06-01 04:00:00", "2024-01-15 00:00:00"


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer as opportunity rows."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    deadline = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 60), "yyyy-MM-dd"))
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, c["c_nationkey"] == n["n_nationkey"])
        .select(
            F.col("o_orderkey").alias("seq"), F.col("c_name").alias("company"), F.array("n_name").alias("cities"), (F.col("n_regionkey") == 0).alias("nationwide"),
            F.array("o_orderpriority").alias("types"), F.array("c_mktsegment").alias("sectors"), F.col("o_orderstatus").alias("education"), F.col("c_mktsegment").alias("kind"),
            F.col("o_totalprice").alias("salary_min"), deadline.alias("deadline"), F.when(F.col("o_orderkey") % 17 == 0, "withdrawn").otherwise("active").alias("listing_status"),
            F.lower(F.concat_ws(" ", "c_name", "n_name", "c_mktsegment", "o_orderpriority")).alias("search_text"), F.col("o_orderdate").alias("published_at"), F.col("o_custkey").alias("company_id"),
        )
    )


NOTICES_SQL = """notices AS (
  SELECT o_orderkey AS seq, c_name AS company, n_name AS city, n_regionkey = 0 AS nationwide, o_orderpriority AS type, c_mktsegment AS sector, o_orderstatus AS education,
         o_totalprice AS salary_min, CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + 60, '%Y-%m-%d') END AS deadline,
         CASE WHEN o_orderkey % 17 = 0 THEN 'withdrawn' ELSE 'active' END AS listing_status,
         lower(concat_ws(' ', c_name, n_name, c_mktsegment, o_orderpriority)) AS search_text, o_orderdate AS published_at, o_custkey AS company_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
OPEN_SQL = f"listing_status <> 'withdrawn' AND (deadline = '' OR deadline[1:10] >= '{TODAY}')"
PAGE_QUERY = Query(cities=("NATION_1", "NATION_3", "NATION_7"), include_nationwide=True, type="1-URGENT", min_salary=50000.0, q="customer nation", sort="salary", page=1, size=50)
PAGE_SQL = f"(city IN ('NATION_1', 'NATION_3', 'NATION_7') OR nationwide) AND type = '1-URGENT' AND salary_min >= 50000 AND contains(search_text, 'customer') AND contains(search_text, 'nation') AND {OPEN_SQL}"


@query(f"WITH {NOTICES_SQL} SELECT seq, company, city, salary_min, deadline FROM notices WHERE {PAGE_SQL} ORDER BY salary_min DESC NULLS LAST, seq LIMIT 50")
def sql_where_page(spark, sf_dir):
    """F1, F2, O1: the flat query's first page; the limit is the feature."""
    found, _ = flat_query.run(notices(spark, sf_dir), PAGE_QUERY, TODAY)
    return found.select("seq", "company", F.col("cities")[0].alias("city"), "salary_min", "deadline")


@query(f"WITH {NOTICES_SQL} SELECT count(*) AS total FROM notices WHERE {PAGE_SQL}")
def total_count(spark, sf_dir):
    """A1: count under the same predicate; no order is made."""
    return flat_query.run(notices(spark, sf_dir), PAGE_QUERY, TODAY)[1]


@query(
    f"""WITH {NOTICES_SQL}, open AS (SELECT * FROM notices WHERE {OPEN_SQL}),
f AS (SELECT 'cities' AS facet, city AS value, count(*) AS cnt FROM open GROUP BY ALL UNION ALL SELECT 'types', type, count(*) FROM open GROUP BY ALL
      UNION ALL SELECT 'sectors', sector, count(*) FROM open GROUP BY ALL UNION ALL SELECT 'education', education, count(*) FROM open GROUP BY ALL)
SELECT facet, value, cnt FROM f QUALIFY facet <> 'cities' OR row_number() OVER (PARTITION BY facet ORDER BY cnt DESC, value) <= 10"""
)
def facets(spark, sf_dir):
    """A2: four facets in one scan, the ten largest cities."""
    rows = notices(spark, sf_dir).where(flat_query.predicate(Query(), TODAY))
    return relational.facet_counts(rows, ["education"], ["cities", "types", "sectors"], top={"cities": 10})


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def keyword_and(spark, sf_dir):
    """F2, P5: all terms occur in the lower-cased text."""
    return table(spark, sf_dir, "documents").where(text.contains_all(F.lower("text"), "The license")).select("doc_id")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def search_join(spark, sf_dir):
    """Optional facts by id; the text column is never read."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_membership(spark, sf_dir):
    """J1."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.semi(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), keys, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, sf_dir):
    """X2, X5."""
    keys = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])


def _nested(spark, sf_dir, needed):
    """Line items nested under their order; a condition that a nested row must meet anyway is applied in the scan."""
    items = table(spark, sf_dir, "lineitem").where(needed).select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "l_extendedprice").alias("p"))
    return items.groupBy("l_orderkey").agg(F.collect_list("p").alias("positions"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40 AND year(l_shipdate) = 1998")
def same_row_exists(spark, sf_dir):
    """the conditions hold for one and the same nested row."""
    test = lambda p: (p["l_returnflag"] == "R") & (p["l_quantity"] >= 40) & (F.year(p["l_shipdate"]) == 1998)
    return _nested(spark, sf_dir, "l_returnflag = 'R' AND l_quantity >= 40").where(relational.same_row_exists(F.col("positions"), test)).select("l_orderkey")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_returnflag = 'A' AND l_quantity < 5")
def nested_explode_positions(spark, sf_dir):
    """Child rows attached, flattened and filtered."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    rows = o.join(_nested(spark, sf_dir, "l_returnflag = 'A' AND l_quantity < 5"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.inline("positions"))
    return rows.where("l_returnflag = 'A' AND l_quantity < 5").select("o_orderkey", "l_linenumber", "l_quantity")


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', '', 'g'), '^[【\\[(][^】\\])]{1,20}[】\\])]', ''),
  '(校园招聘(简章|公告|启事)?|招聘(简章|公告|启事|信息)?|简章|公告|启事|专场)$', ''), '(20[0-9]{2})年$', '\\1')) AS core
FROM (SELECT doc_id, replace(replace(CASE doc_id % 5 WHEN 0 THEN '【急】' WHEN 1 THEN '[2026] ' ELSE '' END || coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' 2026年 招聘公告' WHEN 1 THEN '2026年' ELSE '' END, '（', '('), '）', ')') AS text FROM documents)"""
)
def title_norm(spark, sf_dir):
    """Core form of a heading, over every whole text with tags, years and notice words around some."""
    n = F.col("doc_id")
    head, tail = F.when(n % 5 == 0, "【急】").when(n % 5 == 1, "[2026] ").otherwise(""), F.when(n % 4 == 0, " 2026年 招聘公告").when(n % 4 == 1, "2026年").otherwise("")
    title = F.concat(head, F.coalesce("text", F.lit("")), tail)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.title_core(title).cast("binary")).alias("core"))


@query("SELECT c_custkey, regexp_replace(c_name, '\\s+', '', 'g') AS company FROM customer")
def company_norm(spark, sf_dir):
    """P8; the cases with legal forms are fixture tests."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.company_norm(F.col("c_name")).alias("company"))


@query("SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, CAST(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS VARCHAR) AS day_text FROM events")
def beijing_day(spark, sf_dir):
    """Business day, from a timestamp and from its ISO text."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", timeutil.day_of(F.col("ts")).cast("string").alias("day"), timeutil.business_day(iso).alias("day_text"))


@query(
    f"""WITH {NOTICES_SQL}, t AS (SELECT seq, CASE WHEN deadline <> '' THEN CAST(deadline AS TIMESTAMP) + INTERVAL '23:59:59.999' HOUR TO SECOND - INTERVAL 8 HOUR END AS due, deadline FROM notices)
SELECT seq, CASE WHEN due IS NULL THEN NULL WHEN due <= TIMESTAMP '1998-06-01 04:00:00' THEN 'expired' WHEN d <= 3 THEN 'urgent' WHEN d <= 7 THEN 'warning' ELSE 'normal' END AS urgency, due < TIMESTAMP '1998-06-01 04:00:00' AND due IS NOT NULL AS expired
FROM (SELECT *, greatest(0, date_diff('day', DATE '1998-06-01', CAST(due + INTERVAL 8 HOUR AS DATE))) AS d FROM t)""".replace("+ INTERVAL '23:59:59.999' HOUR TO SECOND", "+ INTERVAL 86399999 MILLISECONDS")
)
def countdown(spark, sf_dir):
    """Urgency of a deadline that lasts to its UTC+8 day's end."""
    d = F.col("deadline")
    return notices(spark, sf_dir).select("seq", timeutil.countdown(d, at(NOW)).alias("urgency"), timeutil.expired(d, at(NOW)).alias("expired"))


@query(
    f"""WITH {NOTICES_SQL}, t AS (SELECT *, CASE WHEN deadline <> '' THEN CAST(deadline AS TIMESTAMP) + INTERVAL 86399999 MILLISECONDS - INTERVAL 8 HOUR END AS due FROM notices)
SELECT seq, CASE WHEN listing_status = 'withdrawn' THEN 'expired' WHEN due < TIMESTAMP '1998-06-01 04:00:00' THEN 'expired' WHEN sector = 'MACHINERY' THEN 'selection' WHEN type = '1-URGENT' THEN 'extended' WHEN type = '2-HIGH' THEN 'supplemental'
  WHEN deadline <> '' AND ceil(CAST(epoch_ms(CAST(deadline AS TIMESTAMP)) - epoch_ms(TIMESTAMP '1998-06-01 04:00:00') AS DOUBLE) / 86400000) BETWEEN 0 AND 3 THEN 'expiring_soon' ELSE 'accepting' END AS stage FROM t"""
)
def lifecycle_stage(spark, sf_dir):
    """First stage that holds."""
    kind = F.when(F.col("types")[0] == "1-URGENT", "extended").when(F.col("types")[0] == "2-HIGH", "supplemental").otherwise("")
    stage = facts.lifecycle_stage(F.col("company"), F.col("deadline"), F.col("listing_status"), kind, F.col("sectors")[0] == "MACHINERY", at(NOW))
    return notices(spark, sf_dir).select("seq", stage.alias("stage"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_totalprice DESC, o_orderkey) AS seq FROM orders")
def newest_rank(spark, sf_dir):
    """Global rank by day, tie value and id without a single-task window."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return relational.ranked(o, [(F.col("day"), "desc"), (F.col("o_totalprice"), "desc"), F.col("o_orderkey")]).select("o_orderkey", "seq")


@query(f"WITH {NOTICES_SQL} SELECT seq, deadline FROM notices WHERE {OPEN_SQL} ORDER BY nullif(deadline, '') NULLS LAST, seq LIMIT 20 OFFSET 20")
def deadline_sort(spark, sf_dir):
    """O1: second page by deadline, unknown last."""
    return flat_query.run(notices(spark, sf_dir), Query(sort="deadline", page=2), TODAY)[0].select("seq", "deadline")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def set_algebra(spark, sf_dir):
    """Union, difference."""
    o = table(spark, sf_dir, "orders")
    a = o.where("o_totalprice > 300000").select("o_orderkey")
    b = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.missing(a.unionByName(b), o.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"]).distinct()


@query(
    """SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_ord, count(*) AS size, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY ALL"""
)
def group_by_employer(spark, sf_dir):
    """Groups with ordered members."""
    g = entity.grouped(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", ["o_totalprice"])
    return g.select("o_custkey", "o_orderstatus", "first_ord", "size", F.expr("array_join(transform(members, m -> cast(m.ord AS string)), ',')").alias("members"))


@query(
    """WITH c AS (SELECT p_partkey, p_name, p_type, p_brand, count(*) OVER (PARTITION BY p_brand, p_name) AS a, count(*) OVER (PARTITION BY p_brand, p_name, p_type) AS b FROM part)
SELECT p_partkey, CASE WHEN a = 1 THEN p_name WHEN b = 1 THEN p_name || ' · ' || p_type ELSE p_name || ' · ' || CAST(p_partkey AS VARCHAR) END AS label FROM c"""
)
def role_counts(spark, sf_dir):
    """Labels made unique within their group."""
    p = table(spark, sf_dir, "part").withColumn("city", F.col("p_partkey").cast("string"))
    return entity.role_labels(p, ["p_brand"], "p_name", "p_type", "city").select("p_partkey", "label")


@query(
    """SELECT o_custkey AS employer, o_orderpriority AS kind, min(o_orderkey) AS id, arg_min(o_totalprice, o_orderkey) AS price, strftime(min(o_orderdate), '%Y-%m-%d') AS published_at,
  strftime(max(o_orderdate), '%Y-%m-%d') AS deadline, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses,
  arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'P') AS first_final, count(*) AS members FROM orders GROUP BY ALL"""
)
def dedup_merge(spark, sf_dir):
    """A4: one record per key, a rule per field."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("employer"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"), F.array("o_orderstatus").alias("statuses"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("first_final"),
    ).withColumn("key", F.struct("employer", "kind")).withColumn("ord", F.col("id"))
    rules = {"published_at": entity.earliest, "deadline": entity.latest, "statuses": entity.sorted_union, "first_final": entity.first_known}
    merged = entity.merge_groups(o, "key", "ord", rules, ["id", "price"])
    return merged.select("key.*", "id", "price", "published_at", "deadline", F.array_join("statuses", ",").alias("statuses"), "first_final", "members")


@query(
    """SELECT md5(lower(trim(coalesce(text, '')))) AS k, min(doc_id) AS doc_id, count(*) AS members, count(DISTINCT source) AS sources FROM documents GROUP BY 1"""
)
def dedup_documents(spark, sf_dir):
    """A4: groups by a normal form of the whole text."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.lower(F.trim(F.coalesce("text", F.lit("")))).cast("binary")).alias("k"), "doc_id", "source")
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), F.count_distinct("source").alias("sources"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def keyed_union(spark, sf_dir):
    """A4f, A5, W2: first of each key, as an argmin with partial aggregation."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    kept = relational.keyed_union(li, ["l_orderkey", "l_partkey"], [F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")])
    return kept.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query(
    f"""WITH {NOTICES_SQL} SELECT count(*) FILTER (CAST(published_at AS DATE) = DATE '1998-06-01') AS today, count(*) FILTER (type = '2-HIGH') AS supplement, count(*) FILTER (deadline BETWEEN '1998-06-01' AND '1998-06-04') AS urgent,
  count(*) FILTER (salary_min >= 400000) AS high_salary, count(*) FILTER (listing_status = 'withdrawn') AS withdrawn FROM notices"""
)
def kpi_counts(spark, sf_dir):
    """Conditional counts in one scan."""
    flags = {
        "today": F.col("published_at").cast("date") == F.lit("1998-06-01").cast("date"),
        "supplement": F.array_contains("types", "2-HIGH"),
        "urgent": F.col("deadline").between("1998-06-01", "1998-06-04"),
        "high_salary": F.col("salary_min") >= 400000,
        "withdrawn": F.col("listing_status") == "withdrawn",
    }
    return relational.flag_counts(notices(spark, sf_dir), flags)


def _user_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("applied"), F.bool_or((F.col("event_type") == "click") & (F.col("value") > 30)).alias("saved"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 150)).alias("hidden"), F.max("ts").alias("read_at"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("note"), F.max("ts").alias("updated_at"),
    )


USER_STATE_SQL = "u AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 100) AS applied, bool_or(event_type = 'click' AND value > 30) AS saved, bool_or(event_type = 'error' AND value > 150) AS hidden, max(ts) AS read_at, arg_max(event_type, (ts, event_id)) AS note FROM events GROUP BY 1)"


@query(f"WITH {USER_STATE_SQL} SELECT o_orderkey, saved, applied, hidden, read_at, note FROM orders LEFT JOIN u ON o_custkey = user_id WHERE NOT coalesce(hidden, false) AND coalesce(saved, false) AND NOT coalesce(applied, false)")
def personal_view(spark, sf_dir):
    """User state joined, the planned view."""
    from .operators.workspace import personal_predicate

    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = keys.join(_user_state(spark, sf_dir), keys["o_custkey"] == F.col("user_id"), "left")
    return joined.where(personal_predicate("planned")).select("o_orderkey", "saved", "applied", "hidden", "read_at", "note")


@query(f"WITH {USER_STATE_SQL} SELECT c_custkey, saved, applied, hidden, read_at, note FROM customer LEFT JOIN u ON c_custkey = user_id")
def user_state_join(spark, sf_dir):
    """State by id and aliases, flags by or."""
    return entity.with_user_state(table(spark, sf_dir, "customer").select("c_custkey"), _user_state(spark, sf_dir), "c_custkey", None, "user_id").select("c_custkey", "saved", "applied", "hidden", "read_at", "note")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def lww_merge(spark, sf_dir):
    """Newest version per key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return state.newest(e, ["user_id"], "ts", tie="event_id").select("user_id", "event_type", "value", "ts")


@query(
    """WITH w AS (SELECT event_id, user_id, event_type, row_number() OVER x = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER x AS changed, ts FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, changed, CAST(sum(CAST(changed AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS revision FROM w"""
)
def upsert_state(spark, sf_dir):
    """Revisions of a replayed log."""
    return state.revisions(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "changed", "revision")


@query(
    """WITH w AS (SELECT *, lag(value) OVER x AS ov, lag(event_type) OVER x AS ot, row_number() OVER x AS rn FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT event_id, CASE WHEN value > ov + 50 THEN 'raised' WHEN value < ov - 50 THEN 'cut' WHEN event_type <> ot THEN 'moved' END AS change FROM w WHERE rn > 1)
SELECT * FROM c WHERE change IS NOT NULL"""
)
def change_events(spark, sf_dir):
    """First detector that fires."""
    tests = [("raised", F.col("value") > F.col("old_value") + 50), ("cut", F.col("value") < F.col("old_value") - 50), ("moved", F.col("event_type") != F.col("old_event_type"))]
    return state.change_events(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], tests, ["value", "event_type"]).select("event_id", "change")


@query(
    """WITH a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' AND o_orderkey % 11 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice = b.o_totalprice AND a.o_orderstatus = b.o_orderstatus THEN 'same' ELSE 'changed' END AS diff
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey"""
)
def snapshot_diff(spark, sf_dir):
    """J15, A25."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderdate < timestamp'1998-01-01' AND o_orderkey % 5 <> 0")
    new = o.where("o_orderdate < timestamp'1998-06-01' AND o_orderkey % 11 <> 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    return state.snapshot_diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(
    f"""WITH {NOTICES_SQL} SELECT CASE WHEN listing_status = 'withdrawn' THEN 'withdrawn' WHEN deadline <> '' AND deadline < '{TODAY}' THEN 'expired' WHEN nationwide THEN 'nationwide' WHEN salary_min < 10000 THEN 'low_pay' ELSE 'unexplained' END AS reason, count(*) AS cnt FROM notices GROUP BY 1"""
)
def reason_attribution(spark, sf_dir):
    """Exclusive first reason, counted."""
    reasons = [("withdrawn", F.col("listing_status") == "withdrawn"), ("expired", (F.col("deadline") != "") & (F.col("deadline") < TODAY)), ("nationwide", F.col("nationwide")), ("low_pay", F.col("salary_min") < 10000)]
    return state.attributed(notices(spark, sf_dir), reasons)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS seen, value < 80 AS complete, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type <> 'error', value < 80) AS n FROM events),
r AS (SELECT user_id, 0 AS n, 0 AS misses, CAST(NULL AS BIGINT) AS since, 'active' AS status FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, e.n, CASE WHEN e.seen THEN 0 WHEN NOT e.complete THEN r.misses WHEN r.since IS NULL OR e.t - r.since >= 21600000000 THEN r.misses + 1 ELSE r.misses END,
    CASE WHEN e.seen THEN NULL WHEN NOT e.complete THEN r.since WHEN r.since IS NULL OR e.t - r.since >= 21600000000 THEN e.t ELSE r.since END,
    CASE WHEN e.seen THEN 'active' WHEN NOT e.complete THEN r.status WHEN CASE WHEN r.since IS NULL OR e.t - r.since >= 21600000000 THEN r.misses + 1 ELSE r.misses END >= 2 THEN 'withdrawn' ELSE 'unconfirmed' END
  FROM r JOIN e ON r.user_id = e.user_id AND e.n = r.n + 1)
SELECT user_id, arg_max(status, n) AS status, arg_max(misses, n) AS misses FROM r GROUP BY 1"""
)
def hysteresis(spark, sf_dir):
    """Withdrawn after two complete misses six hours apart; an error event is a miss."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("seen"), (F.col("value") < 80).alias("complete"))
    return state.listing_status(e, "user_id", "ts", "seen", "complete")


@query(
    """WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n, CAST(max(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY n DESC, q DESC) AS rk, count(*) OVER (PARTITION BY l_partkey, n, q) AS ties FROM c)
SELECT l_partkey, l_suppkey, n, q FROM r WHERE rk = 1 AND ties = 1"""
)
def unique_best_match(spark, sf_dir):
    """Best candidate unless tied."""
    # Nearly every row is a pair of its own: counting before the rows are dealt would hold them all and join few.
    pairs = relational.dealt(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey")
    c = pairs.agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return relational.unique_best(c, ["l_partkey"], ["n", "q"])


@query(
    """WITH s AS (SELECT c.o_orderkey AS child, p.o_orderkey AS parent, least(c.o_totalprice, p.o_totalprice) / greatest(c.o_totalprice, p.o_totalprice) AS score FROM orders c JOIN orders p ON c.o_custkey = p.o_custkey AND c.o_orderkey <> p.o_orderkey
  AND date_diff('day', CAST(p.o_orderdate AS DATE), CAST(c.o_orderdate AS DATE)) BETWEEN 0 AND 180)
SELECT child, parent, round(score, 6) AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY child ORDER BY score DESC, parent) = 1"""
)
def range_link(spark, sf_dir):
    """Equi key, 0 to 180 days, best score, first parent of equals."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    score = F.least("c.o_totalprice", "p.o_totalprice") / F.greatest("c.o_totalprice", "p.o_totalprice")
    return relational.range_link(o, o, "o_custkey", "o_orderdate", "o_orderdate", 180, score, 0.6, "o_orderkey", "o_orderkey").withColumn("score", F.round("score", 6))


@query("WITH a AS (SELECT p_name AS alias, p_brand AS brand FROM part UNION ALL SELECT p_type, p_brand FROM part) SELECT alias, min(brand) AS brand FROM a GROUP BY 1 HAVING count(DISTINCT brand) = 1 UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def alias_resolution(spark, sf_dir):
    """Aliases that name one entity only."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.explode(F.array("p_name", "p_type")).alias("alias"), F.col("p_brand").alias("brand"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("brand"))
    return relational.unique_alias(a, "alias", "brand").unionByName(relational.unique_alias(n, "alias", "brand"))


@query(
    """WITH p AS (SELECT event_type AS dimension, user_id % 10 AS entity, user_id, avg(CASE WHEN value > 50 THEN 1 WHEN value < 25 THEN -1 ELSE 0 END) AS p FROM events GROUP BY ALL),
d AS (SELECT entity, dimension, count(*) AS contributors, count(*) FILTER (p > 0) AS positive, count(*) FILTER (p < 0) AS negative, CASE WHEN count(*) >= 10 THEN round((sum((p + 1) * 2 + 1) + 15) / (count(*) + 5) + 1e-9, 1) END AS score FROM p GROUP BY ALL)
SELECT * FROM d"""
)
def shrunk_score(spark, sf_dir):
    """Contributor means, then a mean shrunk to the prior."""
    polarity = F.when(F.col("value") > 50, 1).when(F.col("value") < 25, -1).otherwise(0)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("entity"), F.col("event_type").alias("dimension"), F.col("user_id").alias("contributor"), polarity.alias("polarity"))
    return reputation.dimension_scores(e)


@query("SELECT s_suppkey, round(least(14, s_suppkey % 20) * 8 + least(32.0, log2(1 + n) * 4), 4) AS priority FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def priority_queue(spark, sf_dir):
    """A20."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey").join(n, "s_suppkey")
    return s.select("s_suppkey", F.round(reputation.queue_priority(F.col("s_suppkey") % 20, F.col("n")), 4).alias("priority"))


@query(
    """SELECT event_type, count(*) AS total, count(*) FILTER (ts <= TIMESTAMP '2024-01-15' AND ts >= TIMESTAMP '2024-01-08') AS recent, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS ahead,
  round(min(CAST(epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts) AS DOUBLE) / 3600000000) FILTER (ts <= TIMESTAMP '2024-01-15'), 4) AS newest_age_hours FROM events GROUP BY 1"""
)
def freshness_audit(spark, sf_dir):
    """A22."""
    return audit.freshness(table(spark, sf_dir, "events"), "event_type", "ts", at(EVENT_NOW))


@query("SELECT n_nationkey, n_name, count(o_orderkey) AS active, count(*) FILTER (o_orderstatus = 'F') AS final, count(*) FILTER (o_orderstatus = 'P') AS pending FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def coverage_by_city(spark, sf_dir):
    """Every place, also without facts."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderstatus")
    places = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return audit.coverage(places, o, "n_nationkey", F.lit(True), {"final": F.col("o_orderstatus") == "F", "pending": F.col("o_orderstatus") == "P"})


@query("SELECT 'p_name' AS field, count(p_name) AS present, CAST(sum(strlen(p_name)) AS BIGINT) AS bytes FROM part UNION ALL SELECT 'p_brand', count(p_brand), CAST(sum(strlen(p_brand)) AS BIGINT) FROM part UNION ALL SELECT 'p_size', count(p_size), CAST(sum(strlen(CAST(p_size AS VARCHAR))) AS BIGINT) FROM part")
def field_profile(spark, sf_dir):
    """One scan for all columns."""
    return relational.field_profile(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"])


@query("""SELECT doc_id, sha256('{"p0":"' || lang || '","p1":"' || source || '"}')[1:20] AS fingerprint FROM documents""")
def fingerprint(spark, sf_dir):
    """P48."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), digits=20).alias("fingerprint"))


@query(
    """WITH RECURSIVE d AS (SELECT source, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
r AS (SELECT source, doc_id, bytes, n, 0 AS chunk, bytes AS held, 8192 AS lim FROM d WHERE n = 1
  UNION ALL SELECT d.source, d.doc_id, d.bytes, d.n, CASE WHEN r.held > 0 AND r.held + d.bytes > r.lim THEN r.chunk + 1 ELSE r.chunk END,
    CASE WHEN r.held > 0 AND r.held + d.bytes > r.lim THEN d.bytes ELSE r.held + d.bytes END, CASE WHEN r.held > 0 AND r.held + d.bytes > r.lim THEN 65536 ELSE r.lim END
  FROM r JOIN d ON r.source = d.source AND d.n = r.n + 1)
SELECT source, doc_id, bytes, chunk FROM r"""
)
def chunk_rows(spark, sf_dir):
    """Greedy byte budget per source; sequential by nature, over narrow rows."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return relational.chunked(d, "source", "doc_id", "bytes", 65536, 8192)


@query("""SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^\\s/@]+(/\\S*)?$') THEN u END AS url FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)""")
def url_clean(spark, sf_dir):
    """P46."""
    return table(spark, sf_dir, "pages").select("page_id", text.safe_url(F.col("url")).alias("url"))


@query()
def html_text(spark, sf_dir):
    """DuckDB lacks back-references; tests hold the words of every page against a parser."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain_html(F.col("html")).alias("text"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
  '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[phone]\2', 'g'), '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])', '\1[phone]\2', 'g')) AS redacted FROM documents"""
)
def redact_pii(spark, sf_dir):
    """Every whole text with addresses and mobile numbers redacted."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(F.coalesce("text", F.lit(""))).cast("binary")).alias("redacted"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'published' ELSE 'source_repost' END AS kind FROM events")
def first_published(spark, sf_dir):
    """The first of a type is the publication, later ones are reposts."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.when(F.row_number().over(w) == 1, "published").otherwise("source_repost").alias("kind"))


@query(
    """SELECT event_id, ts + INTERVAL 2 HOUR < TIMESTAMP '2024-01-15' AS past, CASE WHEN ts + INTERVAL 2 HOUR < TIMESTAMP '2024-01-15' THEN 2305843009213693952 - (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) ELSE epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15') END AS agenda_order FROM events"""
)
def agenda(spark, sf_dir):
    """Upcoming first, past in reverse."""
    e = table(spark, sf_dir, "events")
    return calendar.agenda(e, "ts", F.col("ts") + F.expr("INTERVAL 2 HOURS"), at(EVENT_NOW)).select("event_id", "past", "agenda_order")


@query(
    """SELECT o_orderkey, 'followup' AS label, o_orderdate AS at FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderdate <= TIMESTAMP '1998-06-02 04:00:00'
UNION ALL SELECT o_orderkey, 'deadline', o_orderdate FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1998-06-01 04:00:00' AND TIMESTAMP '1998-06-04 04:00:00'"""
)
def reminders(spark, sf_dir):
    """O11."""
    o = table(spark, sf_dir, "orders").withColumn("next", F.col("o_orderdate"))
    return calendar.reminders(o, "o_orderkey", at(NOW), "o_orderdate", "next", F.col("o_orderstatus") == "O", F.lit(False), F.col("o_orderkey") % 13 == 0)


@query("SELECT o_orderkey, 'ordered' AS milestone, o_orderdate AS at FROM orders UNION ALL SELECT o_orderkey, 'first_ship', min(l_shipdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderkey, 'last_ship', max(l_shipdate) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def milestone_unpivot(spark, sf_dir):
    """K7, K8."""
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(ship, "o_orderkey", "left")
    return calendar.milestones(o, "o_orderkey", {"ordered": "o_orderdate", "first_ship": "first", "last_ship": "last"})


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'MACHINERY' THEN 'ineligible' WHEN c_mktsegment = 'HOUSEHOLD' OR c_acctbal > 9000 THEN 'unknown' ELSE 'eligible' END AS status,
  CAST(c_acctbal < 0 AS INT) + CAST(c_mktsegment = 'MACHINERY' AS INT) AS conflicts FROM customer"""
)
def eligibility(spark, sf_dir):
    """three-valued verdict from lists of conflicts and unknowns."""
    conflicts = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "balance"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment")))
    unknowns = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "HOUSEHOLD", "segment"), F.when(F.col("c_acctbal") > 9000, "balance")))
    return table(spark, sf_dir, "customer").select("c_custkey", facts.verdict(conflicts, unknowns).alias("status"), F.size(conflicts).alias("conflicts"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase') AND value IS NOT NULL AND value >= 0 AND strlen(props) <= 4096")
def rum_valid(spark, sf_dir):
    """Valid telemetry rows with their parsed payload."""
    from .streaming.telemetry import valid

    return valid(table(spark, sf_dir, "events")).select("event_id", F.col("payload.k").alias("k"))


@query()
def rum_sample(spark, sf_dir):
    """A fifth of sessions by hash, errors always; sampling is the feature, held against brute force in tests."""
    from .streaming.telemetry import sampled

    return sampled(table(spark, sf_dir, "events"), "user_id").select("event_id", "user_id", "event_type")


@query(
    """WITH n AS (SELECT event_id, event_type = 'error' AS first, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT event_id, CAST(CASE WHEN first THEN (n // 4) * 5 + n % 4 ELSE n * 5 + 4 END AS BIGINT) AS slot FROM n"""
)
def interleave(spark, sf_dir):
    """Four of one class, one of the other."""
    e = table(spark, sf_dir, "events")
    return relational.interleaved(e, F.col("event_type") == "error", [F.col("ts"), F.col("event_id")]).select("event_id", "slot")


@query()
def evidence_dedup(spark, sf_dir):
    """Greedy over three keys; sequential, held against brute force over all documents in tests."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("fp"), F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("url"))
    return relational.greedy_unique(d, "source", ["url", "fp", "doc_id"], ["doc_id"])


@query()
def opinion_signals(spark, sf_dir):
    """Opinion clauses of user turns, per dimension."""
    from .operators.extract import OPINION_RULES, opinion_signals as signals

    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    rules = [*OPINION_RULES, ("growth", 1, "the"), ("growth", -1, "leaux")]
    return signals(c, F.col("text"), rules).select("conv_id", "turn", "dimension", "polarity", "quote")


@query(
    """WITH one AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1)
SELECT row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC, o_custkey) AS seq, o_custkey, o_orderkey FROM one QUALIFY seq <= 60"""
)
def mart_first_screen(spark, sf_dir):
    """Newest row of each key, then the first 60; the limit is the feature."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return collection.mart(o, "o_custkey", "day", "o_orderkey")[1].select(F.col("seq").cast("long").alias("seq"), "o_custkey", "o_orderkey")


@query(
    """WITH s AS (SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END AS stem FROM part)
SELECT a.k AS child, arg_max(b.k, (length(b.stem), -b.k)) AS parent FROM s a JOIN s b ON a.k <> b.k AND length(a.stem) >= 7 AND length(b.stem) >= 7 AND contains(a.stem, b.stem) AND (a.stem <> b.stem OR b.k < a.k) GROUP BY 1"""
)
def sibling_links(spark, sf_dir):
    """Containment without a cross join."""
    p = table(spark, sf_dir, "part")
    stem = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""))
    return collection.sibling_links(p.select(F.col("p_partkey").alias("k"), stem.alias("stem")), "k", "stem")


@query(
    """WITH p AS (SELECT user_id % 10 AS entity, event_type AS dimension, user_id, avg(CASE WHEN value > 50 THEN 1 WHEN value < 25 THEN -1 ELSE 0 END) AS p FROM events GROUP BY ALL),
d AS (SELECT entity, dimension, CASE WHEN count(*) >= 10 THEN round((sum((p + 1) * 2 + 1) + 15) / (count(*) + 5) + 1e-9, 1) END AS score FROM p GROUP BY ALL),
w AS (SELECT *, CASE dimension WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.25 ELSE 0.15 END AS w FROM d WHERE score IS NOT NULL)
SELECT e.entity, count(w.w) AS scored, CASE WHEN count(w.w) >= 3 THEN round(sum(w.w * w.score) / sum(w.w) + 1e-9, 1) END AS score FROM (SELECT DISTINCT entity FROM d) e LEFT JOIN w ON w.entity = e.entity GROUP BY 1"""
)
def entity_scores(spark, sf_dir):
    """A10: weighted mean of scored dimensions."""
    polarity = F.when(F.col("value") > 50, 1).when(F.col("value") < 25, -1).otherwise(0)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("entity"), F.col("event_type").alias("dimension"), F.col("user_id").alias("contributor"), polarity.alias("polarity"))
    weights = {"click": 0.3, "view": 0.3, "error": 0.25, "purchase": 0.15, "signup": 0.15}
    return reputation.overall_scores(reputation.dimension_scores(e), weights)


@query("SELECT a.user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) b ON a.user_id = b.user_id WHERE a.v IS DISTINCT FROM b.v")
def merge_conflicts(spark, sf_dir):
    """Keys whose two newest versions differ."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    mine, theirs = (state.newest(e.where(F.col("event_id") % 2 == n), ["user_id"], "ts", tie="event_id") for n in (0, 1))
    return state.conflicts(mine, theirs, "user_id", ["event_type"])


@query("SELECT CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """Tumbling five-minute counts; the same operator runs on streams with a watermark."""
    from .streaming.telemetry import windowed_counts as counts

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return counts(e).select(F.floor(F.unix_timestamp("window.start") / 300).alias("bucket"), "event_type", "n")
