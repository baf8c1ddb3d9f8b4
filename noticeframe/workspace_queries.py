"""Queries of the workspace, exam, mart and merge operators, over orders dressed as notices.

``opportunities`` derives every field the operators read from keys and names, the same in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, table
from .functions import facts
from .functions.timeutil import deadline_instant, expired
from .operators import audit, collection, content, entity, examfilter, guards, planning, publish, relational, state
from .operators.content import ContentFilters

NOW = "1998-06-01 04:00:00"
OPP_SQL = """opp AS (
  SELECT o_orderkey AS id, o_custkey, c_name AS company, n_name AS city, o_totalprice AS price, c_mktsegment AS sector, o_orderpriority AS direction,
    n_name || CASE o_orderkey % 11 WHEN 0 THEN ' 补录' WHEN 1 THEN ' 延期公告' WHEN 2 THEN ' 面试名单公示' ELSE ' 招聘' END AS title,
    CASE o_orderkey % 4 WHEN 0 THEN '具体岗位' WHEN 2 THEN '宣讲会' ELSE '公告' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN '第三方线索' ELSE '公开原始来源' END AS provenance,
    CASE o_orderkey % 13 WHEN 0 THEN 'overseas' ELSE 'domestic' END AS domestic_status, CASE o_orderkey % 19 WHEN 0 THEN 1 END AS talk_attached_to,
    CASE o_orderkey % 17 WHEN 0 THEN 'withdrawn' ELSE 'active' END AS listing_status, CASE o_orderkey % 7 WHEN 0 THEN 's-positions' WHEN 1 THEN 'sdei-civil-exams' ELSE 's' END AS source_id,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE strftime(CAST(o_orderdate AS DATE) + 60, '%Y-%m-%d') END AS deadline,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '社招' ELSE '校招' END AS type, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '2026' ELSE '2027' END AS year,
    CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '硕士' WHEN 2 THEN '本科及以上' WHEN 3 THEN '专科' ELSE '本科' END AS education,
    CASE o_orderkey % 8 WHEN 1 THEN 'internship' WHEN 0 THEN NULL ELSE 'full_time' END AS employment_type,
    strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, o_orderkey % 2 = 1 AS has_rows,
    CASE o_orderkey % 10 WHEN 0 THEN 'deadline_extended' WHEN 1 THEN 'positions_updated' WHEN 2 THEN 'supplemental' END AS change,
    CASE o_orderkey % 16 WHEN 0 THEN 'possible' WHEN 1 THEN 'unknown' WHEN 2 THEN 'none' ELSE 'exact' END AS location, o_orderkey % 23 = 0 AS talk_near,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + 60 AS TIMESTAMP) + INTERVAL 86399999 MILLISECONDS - INTERVAL 8 HOUR END AS due,
    (epoch_us(TIMESTAMP '1998-06-01 04:00:00') - epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) / 86400000000.0 BETWEEN -1 AND 30 AS fresh
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
LIVE = f"(due IS NULL OR due >= TIMESTAMP '{NOW}') AND listing_status <> 'withdrawn'"
HOME = "talk_attached_to IS NULL AND domestic_status <> 'overseas'"
# Types as the rows show them: a campus source's positions without a type are 校招.
TYPES = "(type = '校招' OR type = '' AND kind = '具体岗位' AND source_id = 's-positions')"
NO_TYPE = "(type = '' AND NOT (kind = '具体岗位' AND source_id = 's-positions'))"


def now():
    return F.lit(NOW).cast("timestamp")


def opportunities(spark, sf_dir) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")

    def pick(m: int, *values, default):
        out = F.when(k % m == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(k % m == i, v)
        return out.otherwise(default)

    some = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("id"), "o_custkey", F.col("c_name").alias("company"), F.array("n_name").alias("cities"), F.col("o_totalprice").alias("price"), F.array("c_mktsegment").alias("sectors"), F.array("o_orderpriority").alias("directions"),
        F.concat("n_name", pick(11, " 补录", " 延期公告", " 面试名单公示", default=" 招聘")).alias("title"), pick(4, "具体岗位", "公告", "宣讲会", default="公告").alias("kind"),
        pick(3, "第三方线索", default="公开原始来源").alias("provenance"), pick(13, "overseas", default="domestic").alias("domestic_status"), F.when(k % 19 == 0, 1).alias("talk_attached_to"),
        pick(17, "withdrawn", default="active").alias("listing_status"), pick(7, "s-positions", "sdei-civil-exams", default="s").alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 60), "yyyy-MM-dd")).alias("deadline"),
        some(pick(5, "", "社招", default="校招")).alias("types"), some(pick(6, "", "2026", default="2027")).alias("graduation_years"), pick(9, "", "硕士", "本科及以上", "专科", default="本科").alias("education"),
        pick(8, F.lit(None).cast("string"), "internship", default="full_time").alias("employment_type"), day.alias("published_at"), day.alias("first_seen_at"), day.alias("updated_at"),
        pick(10, "deadline_extended", "positions_updated", "supplemental", default=F.lit(None).cast("string")).alias("change"), pick(16, "possible", "unknown", "none", default="exact").alias("location"), (k % 23 == 0).alias("talk_near"),
        F.lower(F.concat_ws(" ", "c_name", "n_name")).alias("search_text"), F.lit(None).cast("array<string>").alias("location_evidence"), F.lit("").alias("excerpt"), F.lit(None).cast("string").alias("stored_stage"), "o_orderdate",
    )
    change = F.struct(F.col("change").alias("type"), F.when(F.col("change") == "positions_updated", "岗位表就绪").otherwise("").alias("label"), F.when(F.col("change") == "deadline_extended", "报名截止时间延长").otherwise("").alias("detail"), F.col("published_at").alias("date"))
    position = F.struct(F.lit("岗").alias("name"), F.col("education"), F.col("cities")[0].alias("city"), F.coalesce(F.get("graduation_years", F.lit(0)), F.lit("")).alias("cohort"), F.array().cast("array<string>").alias("majors"))
    return rows.withColumn("recent_change", F.when(F.col("change").isNotNull(), change)).withColumn("positions", F.when(F.col("id") % 2 == 1, F.array(position)))


@query(
    f"""WITH {OPP_SQL} SELECT id FROM opp WHERE {HOME} AND {LIVE} AND kind = '公告' AND provenance <> '第三方线索' AND (employment_type = 'full_time' OR employment_type IS NULL)
  AND ({TYPES} OR {NO_TYPE}) AND education IN ('', '本科', '本科及以上') AND year IN ('', '2027') AND contains(lower(company), 'customer')"""
)
def content_filter(spark, sf_dir):
    """type, year, education, kind, provenance, employment, expiry and keywords; rows with positions by one and the same position."""
    f = ContentFilters(kind="公告", provenance="高校 / 政府", employment="full_time", type="校招", year="2027", education="本科", keywords=("Customer",))
    return opportunities(spark, sf_dir).where(content.content_predicate(f, now(), F.lit(""))).select("id")


@query(
    f"""WITH {OPP_SQL} SELECT id, {HOME} AND (location = 'possible') AND sector <> '' AND sector = 'MACHINERY' AS possible, {HOME} AND {LIVE} AND (location = 'exact' OR talk_near) AND direction = '1-URGENT' AS exact_urgent FROM opp
WHERE {HOME} AND ((location = 'possible' AND sector = 'MACHINERY') OR ({LIVE} AND (location = 'exact' OR talk_near) AND direction = '1-URGENT'))"""
)
def location_filter(spark, sf_dir):
    """scopes of location, where a coming talk counts as exact; sectors and directions."""
    rows = opportunities(spark, sf_dir)
    a = content.content_predicate(ContentFilters(location_scope="possible", sector="MACHINERY", show_expired=True), now(), F.lit(""), F.col("location"), F.col("talk_near"))
    b = content.content_predicate(ContentFilters(location_scope="exact", direction="1-URGENT"), now(), F.lit(""), F.col("location"), F.col("talk_near"))
    return rows.where(a | b).select("id", a.alias("possible"), b.alias("exact_urgent"))


STAGE_SQL = "CASE WHEN id % 11 = 2 THEN 'selection' WHEN id % 11 = 1 THEN 'extended' WHEN id % 11 = 0 THEN 'supplemental' ELSE '' END"


@query(
    f"""WITH {OPP_SQL} SELECT id, coalesce(change IN ('deadline_extended', 'supplemental'), false) AS changed, {STAGE_SQL} = 'extended' OR coalesce(change = 'deadline_extended', false) AS extended,
  {STAGE_SQL} = 'supplemental' OR coalesce(change = 'supplemental', false) AS supplement, coalesce(change = 'positions_updated', false) AS positions, {STAGE_SQL} = 'selection' AS selection FROM opp WHERE fresh"""
)
def change_filter(spark, sf_dir):
    """each kind of recent change, on recent rows."""
    stage = F.when(F.col("id") % 11 == 2, "selection").when(F.col("id") % 11 == 1, "extended").when(F.col("id") % 11 == 0, "supplemental").otherwise("")
    wanted = {"changed": "有变更", "extended": "截止延期", "supplement": "补录招募", "positions": "岗位调整", "selection": "考核阶段"}
    from .functions.timeutil import recent

    rows = opportunities(spark, sf_dir).where(recent(F.col("published_at"), now()))
    return rows.select("id", *[content.change_matches(w, stage, now()).alias(n) for n, w in wanted.items()])


@query(
    f"""WITH {OPP_SQL} SELECT id, day = '1998-06-01' AS today, id % 11 = 0 OR coalesce(change = 'supplemental', false) AS supplement,
  coalesce(due > TIMESTAMP '{NOW}' AND date_diff('day', DATE '1998-06-01', CAST(due + INTERVAL 8 HOUR AS DATE)) <= 3, false) AS urgent, fresh AND coalesce(change IN ('deadline_extended', 'supplemental'), false) AS change FROM opp"""
)
def radar_focus(spark, sf_dir):
    """the four focuses of every row."""
    return opportunities(spark, sf_dir).select("id", *[content.focus_matches(f, now()).alias(f) for f in ("today", "supplement", "urgent", "change")])


@query(f"WITH {OPP_SQL} SELECT count(*) FILTER (location = 'exact' OR talk_near) AS exact, count(*) FILTER (location = 'possible') AS possible, count(*) FILTER (location = 'unknown') AS unknown FROM opp WHERE {HOME} AND {LIVE}")
def scope_counts(spark, sf_dir):
    """Counts by scope in one scan; rows with a coming talk in two classes."""
    return content.scope_counts(opportunities(spark, sf_dir), content.content_predicate(ContentFilters(), now(), F.lit("")), F.col("location"), F.col("talk_near"))


@query(
    f"""WITH {OPP_SQL} SELECT id FROM opp WHERE NOT (listing_status = 'withdrawn' OR talk_attached_to IS NOT NULL OR source_id = 'sdei-civil-exams' OR domestic_status = 'overseas' OR (kind = '宣讲会' AND id % 5 = 0) OR coalesce(due < TIMESTAMP '{NOW}', false))"""
)
def mart_filter(spark, sf_dir):
    """what the mart keeps."""
    rows = opportunities(spark, sf_dir).withColumn("talk_status", F.when(F.col("id") % 5 == 0, "cancelled"))
    return rows.where(~content.mart_excluded(now())).select("id")


@query(
    f"""WITH {OPP_SQL} SELECT id FROM opp WHERE domestic_status <> 'overseas' AND location = 'exact' AND listing_status <> 'withdrawn' AND (deadline = '' OR CAST(nullif(deadline, '') AS TIMESTAMP) >= TIMESTAMP '{NOW}') AND type IN ('', '校招') AND year IN ('', '2027')"""
)
def benchmark_preset(spark, sf_dir):
    """F24."""
    return opportunities(spark, sf_dir).where(content.benchmark_preset(F.col("location"), now())).select("id")


@query(
    f"""WITH {OPP_SQL}, s AS (SELECT o_custkey AS k, CASE WHEN count(*) >= 5 THEN round(avg(price) / 100000, 3) END AS score FROM opp WHERE id % 3 <> 0 GROUP BY 1)
SELECT id, score FROM opp LEFT JOIN s ON o_custkey = k WHERE score IS NULL OR score >= 2.5"""
)
def reputation_minimum(spark, sf_dir):
    """rows of well-rated or unrated employers."""
    rows = opportunities(spark, sf_dir).select("id", "o_custkey", "price")
    scores = rows.where("id % 3 <> 0").groupBy("o_custkey").agg(F.when(F.count("*") >= 5, F.round(F.avg("price") / 100000, 3)).alias("score"))
    return content.reputation_filter(rows, scores, "o_custkey", 2.5).select("id", "score")


@query(
    f"""WITH {OPP_SQL}, p AS (SELECT id, deadline, due FROM opp WHERE id % 2 = 0 AND id % 3 <> 0 AND id % 29 <> 0 AND (due IS NULL OR due >= TIMESTAMP '{NOW}'))
SELECT id, deadline, row_number() OVER (ORDER BY due NULLS LAST, id) AS place FROM p"""
)
def pending_applications(spark, sf_dir):
    """Saved, open applications in the order of their deadlines, ranked without a single task."""
    rows = opportunities(spark, sf_dir).select("id", "deadline")
    kept = rows.where(content.pending_application(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 29 == 0, expired(F.col("deadline"), now())))
    return relational.ranked(kept.withColumn("_due", deadline_instant(F.col("deadline"))), [(F.col("_due"), "asc"), F.col("id")], "place").select("id", "deadline", "place")


@query(f"WITH {OPP_SQL} SELECT id, id % 5 = 0 OR strptime(day, '%Y-%m-%d') > TIMESTAMP '1998-01-01' AS unread FROM opp")
def unread_rows(spark, sf_dir):
    """never read, or changed since."""
    read = F.when(F.col("id") % 5 != 0, F.lit("1998-01-01").cast("timestamp"))
    return opportunities(spark, sf_dir).select("id", content.unread(F.col("updated_at").cast("timestamp"), read).alias("unread"))


@query(
    f"""WITH {OPP_SQL}, g AS (SELECT o_custkey, direction, id, title, provenance <> '第三方线索' AS official, CASE WHEN id % 4 = 0 THEN '' ELSE company || id END AS body, CASE WHEN id % 2 = 0 THEN day ELSE '' END AS checked, listing_status FROM opp)
SELECT o_custkey, direction, arg_min(title, (NOT official, id)) AS title, arg_min(id, (NOT official, id)) AS source, arg_min(body, (NOT official, id)) FILTER (body <> '') AS body, arg_max(listing_status, (checked, -id)) AS listing_status, count(*) AS members FROM g GROUP BY ALL"""
)
def official_merge(spark, sf_dir):
    """A4g, A4j: an official row's fields replace a third party's; the listing status of the newest check."""
    rows = opportunities(spark, sf_dir).select(
        F.struct("o_custkey", F.col("directions")[0].alias("direction")).alias("key"), "id", F.col("id").alias("source"), "title", (F.col("provenance") != "第三方线索").alias("official"), "listing_status",
        F.when(F.col("id") % 4 == 0, "").otherwise(F.concat("company", F.col("id").cast("string"))).alias("body"), F.when(F.col("id") % 2 == 0, F.col("published_at")).otherwise("").alias("checked"),
    )
    rules = {"best": entity.official_fields(["title", "source"], "official", ["body"]), "listing_status": entity.newest_check("listing_status", "checked")}
    merged = entity.merge_groups(rows, "key", "id", rules)
    return merged.select("key.*", "best.*", "listing_status", "members")


@query("SELECT o_orderkey, o_orderkey % 7 = 0 OR coalesce((o_orderkey // 3) % 7 = 0 AND (SELECT max(o_orderkey) FROM orders) >= o_orderkey // 3, false) AS hidden FROM orders")
def hidden_children(spark, sf_dir):
    """Hidden with its parent; the parent of k is k / 3."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 3).alias("parent"), (F.col("o_orderkey") % 7 == 0).alias("hidden"))
    return content.hidden_by_parent(rows, "o_orderkey", "parent", "hidden").select("o_orderkey", "hidden")


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR event_id % 150 IN (0, user_id)")
def own_posts(spark, sf_dir):
    """Posts that no other company is tagged on."""
    posts = table(spark, sf_dir, "events").withColumn("tag", F.when(F.col("event_type") == "click", F.col("event_id") % 150))
    return content.own_posts(posts, "user_id", "tag").select("event_id")


@query(
    """WITH c AS (SELECT c_custkey, '集团' || (c_custkey % 200) || CASE c_custkey % 3 WHEN 0 THEN '股份有限公司济南' WHEN 1 THEN '山东省分公司' ELSE '支公司' END AS name, '集团' || (c_custkey % 200) || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE '' END AS family FROM customer),
t AS (SELECT DISTINCT '集团' || (c_custkey % 200) AS family FROM customer WHERE c_custkey % 200 < 40)
SELECT min(c_custkey) AS c_custkey FROM c WHERE family NOT IN (SELECT family FROM t) GROUP BY family"""
)
def discovery(spark, sf_dir):
    """One candidate of each family of companies that was not tried within a day."""
    n = F.col("c_custkey")
    stem = F.concat(F.lit("集团"), (n % 200).cast("string"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(stem, F.when(n % 3 == 0, "股份有限公司济南").when(n % 3 == 1, "有限公司山东省分公司").otherwise("支公司")).alias("name"))
    tried = table(spark, sf_dir, "customer").where(n % 200 < 80).select(F.concat(stem, F.lit("有限公司")).alias("name"), F.when(n % 200 < 40, 900_000).otherwise(800_000).alias("attempt_epoch"))
    return planning.discovery_candidates(rows, tried, F.lit(950_000), order="c_custkey").select("c_custkey")


@query(
    """WITH s AS (SELECT s_suppkey AS ord, s_name AS source_id, CASE WHEN s_suppkey % 4 < 3 THEN 'sdei' ELSE 'other' END AS adapter, s_suppkey % 4 AS turn, s_acctbal AS priority, -s_acctbal AS backfill FROM supplier),
h AS (SELECT source_id, true AS head, 0 AS pass, row_number() OVER (ORDER BY turn = 2, n, turn) AS p FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY priority, ord) AS n FROM s WHERE adapter = 'sdei')),
l AS (SELECT source_id, false AS head, CASE WHEN adapter = 'sdei' THEN 2 WHEN source_id = 'Supplier#000000003' THEN 0 ELSE 1 END AS pass,
        CASE WHEN source_id = 'Supplier#000000003' THEN 4.5 WHEN adapter = 'sdei' THEN row_number() OVER (PARTITION BY adapter ORDER BY backfill, ord) ELSE ord END AS p FROM s)
SELECT source_id, head, pass, row_number() OVER (ORDER BY pass, p, source_id) AS place FROM (SELECT * FROM h UNION ALL SELECT * FROM l)"""
)
def scan_plan(spark, sf_dir):
    """Heads in turn, one source early, the rest, then older pages."""
    k = F.col("s_suppkey")
    channel = F.when(k % 4 == 0, "announcements").when(k % 4 == 1, "talks").when(k % 4 == 2, "positions")
    sources = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source_id"), k.alias("ord"), F.when(k % 4 < 3, "sdei").otherwise("other").alias("adapter"), channel.alias("channel"), F.col("s_acctbal").alias("priority"), (-F.col("s_acctbal")).alias("backfill"))
    return planning.scan_order(sources, "ord", "priority", "backfill", "Supplier#000000003")


@query(
    """WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS cat, n_name AS city, o_orderkey % 6 AS st, o_orderkey % 4 AS r, o_orderkey % 3 = 0 AS rows, o_orderkey % 31 = 0 AS hidden, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT id FROM e WHERE NOT hidden AND (city = 'NATION_3' OR (rows AND id % 5 = 0) OR id % 9 = 0) AND (cat = '1-URGENT' OR id % 2 = 0) AND st IN (0, 1) AND r <> 0 AND ((rows AND id % 2 = 0) OR (NOT rows AND id % 7 = 0)) AND contains(lower(c_name), 'customer')"""
)
def exam_filter(spark, sf_dir):
    """City by list, level or position, category with its labels, stage, role, unlimited major, terms."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    strings = lambda c: F.when(c, F.array(F.lit("事业编"))).otherwise(F.array().cast("array<string>"))
    position = F.struct(*[F.lit("").alias(x) for x in ("department", "employer", "position_name", "position_code", "fresh_grad_rule")], F.when(k % 2 == 0, "专业不限").otherwise("数学").alias("major_raw"), F.when(k % 5 == 0, "全国各地NATION_3").otherwise("").alias("city"))
    exams = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        k.alias("id"), F.lit("").alias("title"), F.col("c_name").alias("organizer"), F.when(F.col("o_orderpriority") == "1-URGENT", "事业单位统考").otherwise("其他").alias("exam_category"), strings(k % 2 == 0).alias("bianzhi_types"),
        F.array("n_name").alias("cities"), F.array(F.lit("行测")).alias("exam_subjects"), F.array(F.lit("m")).alias("majors"), F.lit("").alias("excerpt"),
        F.when(k % 6 == 0, "registering").when(k % 6 == 1, "closing_soon").when(k % 6 == 2, "ended").otherwise("upcoming").alias("stage"), F.when(k % 4 == 0, "进展").otherwise("招考简章").alias("notice_role"),
        F.when(k % 9 == 0, "国家级").otherwise("市级").alias("region_level"), F.lit("山东").alias("province"), F.lit("").alias("fresh_grad_summary"), (k % 7 == 0).alias("has_unlimited_major"),
        F.when(k % 3 == 0, F.array(position)).alias("positions"), F.lit(False).alias("saved"), F.array().cast("array<string>").alias("saved_positions"), F.lit("none").alias("status"), (k % 31 == 0).alias("hidden"),
    )
    f = examfilter.ExamFilters(cities=("NATION_3", "全国"), category="事业单位", stage="正在报名", notice_role="仅看招考简章", unlimited_major=True, subject="行测", query="CUSTOMER")
    return exams.where(examfilter.exam_predicate(f)).select("id")


@query(f"WITH {OPP_SQL} SELECT id, price FROM opp WHERE {LIVE} ORDER BY price DESC, id LIMIT 20 OFFSET 40")
def salary_sort(spark, sf_dir):
    """O1: a page by pay, unknown last; the limit is the feature."""
    rows = opportunities(spark, sf_dir).withColumn("seq", F.col("id")).where(~expired(F.col("deadline"), now()) & (F.col("listing_status") != "withdrawn"))
    return relational.page(rows.select("id", "price"), [F.col("price").desc_nulls_last(), F.col("id").asc()], 3, 20)


@query(
    f"""WITH {OPP_SQL} SELECT id, CASE WHEN due IS NULL THEN NULL ELSE greatest(0, date_diff('day', DATE '1998-06-01', CAST(due + INTERVAL 8 HOUR AS DATE))) END AS days_left, coalesce(due < TIMESTAMP '{NOW}', false) AS past,
  CASE WHEN listing_status = 'withdrawn' OR coalesce(due < TIMESTAMP '{NOW}', false) THEN 'closed' WHEN id % 3 = 0 THEN 'long_term' WHEN id % 3 = 1 AND fresh AND CAST(day AS TIMESTAMP) <= TIMESTAMP '{NOW}' THEN 'confirmed_open' ELSE 'unconfirmed' END AS validity FROM opp"""
)
def deadline_state(spark, sf_dir):
    """Days left, past or not, and how sure an offer is."""
    from .functions.timeutil import days_left

    kind = F.when(F.col("id") % 3 == 0, "long_term").when(F.col("id") % 3 == 1, "open")
    valid = facts.validity(F.col("deadline"), F.col("listing_status"), kind, F.lit(True), F.col("published_at"), F.lit(None).cast("string"), now())
    return opportunities(spark, sf_dir).select("id", days_left(F.col("deadline"), now()).alias("days_left"), expired(F.col("deadline"), now()).alias("past"), valid.alias("validity"))


@query(f"WITH {OPP_SQL} SELECT count(*) FILTER (id % 2 = 0) AS saved, count(*) FILTER (id % 3 = 0) AS applied, count(*) FILTER (id % 29 = 0) AS hidden, count(*) FILTER (id % 2 = 0 AND id % 3 <> 0 AND id % 29 <> 0) AS planned, count(*) FILTER (id % 29 <> 0 AND (id % 2 = 0 OR id % 3 = 0)) AS pipeline, count(*) FILTER (id % 5 = 0) AS unread FROM opp")
def personal_counts(spark, sf_dir):
    """Six counts of a workspace in one scan."""
    from .operators.workspace import personal_predicate

    rows = opportunities(spark, sf_dir).select((F.col("id") % 2 == 0).alias("saved"), (F.col("id") % 3 == 0).alias("applied"), (F.col("id") % 29 == 0).alias("hidden"), F.when(F.col("id") % 5 != 0, now()).alias("read_at"))
    flags = {"saved": F.col("saved"), "applied": F.col("applied"), "hidden": F.col("hidden"), "planned": personal_predicate("planned"), "pipeline": personal_predicate("pipeline"), "unread": F.col("read_at").isNull()}
    return relational.flag_counts(rows, flags)


@query(
    f"""WITH {OPP_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN '1990-01-01 published|' || day || ' ' || coalesce(change, 'noted') || '|' || day || ' source_repost' ELSE
  list_reduce(list_sort([day || ' published', day || ' ' || coalesce(change, 'noted')]), lambda a, b: a || '|' || b) END AS line FROM opp WHERE change IS DISTINCT FROM 'supplemental'"""
)
def timeline_synth(spark, sf_dir):
    """Recorded events, the change and one publication; later ones are reposts."""
    entry = lambda d, t: F.struct(d.alias("date"), t.alias("type"), F.lit("").alias("title"))
    rows = opportunities(spark, sf_dir).where("change IS DISTINCT FROM 'supplemental'")
    day = F.col("published_at")
    recorded = F.when(F.col("id") % 2 == 0, F.array(entry(F.lit("1990-01-01"), F.lit("published")), entry(day, F.lit("published"))))
    line = publish.timeline(recorded, day, entry(day, F.coalesce("change", F.lit("noted"))))
    shown = F.transform(line, lambda e: F.concat_ws(" ", e["date"], e["type"]))
    # A repost sorts with the day's other events by its recorded type; shown here by text.
    first = F.slice(shown, 1, 1)
    even = F.concat(first, F.array_sort(F.slice(shown, 2, 10)))
    return rows.select("id", F.array_join(F.when(F.col("id") % 2 == 0, even).otherwise(F.array_sort(shown)), "|").alias("line"))


@query("SELECT count(*) AS sources, count(*) FILTER (s_acctbal > 0) AS healthy, count(*) FILTER (s_acctbal <= 0) AS failing, CAST(sum(s_nationkey) AS BIGINT) AS pending, max(s_suppkey) AS last_success FROM supplier")
def health(spark, sf_dir):
    """A21."""
    return audit.health(table(spark, sf_dir, "supplier"), F.col("s_acctbal") > 0, F.col("s_acctbal") <= 0, "s_nationkey", "s_suppkey").withColumn("pending", F.col("pending").cast("long"))


@query(f"WITH {OPP_SQL} SELECT city, min(due) AS next_due, count(*) AS open FROM opp WHERE due >= TIMESTAMP '{NOW}' AND kind = '宣讲会' GROUP BY 1")
def upcoming(spark, sf_dir):
    """What comes next in each city."""
    rows = opportunities(spark, sf_dir).where("kind = '宣讲会'").select(F.col("cities")[0].alias("city"), deadline_instant(F.col("deadline")).alias("due"))
    return rows.where(F.col("due") >= now()).groupBy("city").agg(F.min("due").alias("next_due"), F.count("*").alias("open"))


@query(
    f"""WITH {OPP_SQL} SELECT o_custkey, arg_max(company, (day, id)) AS intro, max(id) AS newest FROM opp WHERE id % 3 = 0 GROUP BY 1"""
)
def latest_intro(spark, sf_dir):
    """The latest intro of each employer, seen on rows that have none."""
    rows = opportunities(spark, sf_dir).select("id", "o_custkey", F.when(F.col("id") % 3 == 0, F.col("company")).otherwise("").alias("intro"), F.col("published_at").alias("day"))
    reused = publish.reused_intros(rows, "o_custkey", "intro", "day", "id")
    newest = rows.where("id % 3 = 0").groupBy("o_custkey").agg(F.max("id").alias("newest"))
    return reused.where("intro IS NOT NULL").groupBy("o_custkey").agg(F.max("intro").alias("intro")).join(newest, "o_custkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber, left(sha256(CAST(l_orderkey AS VARCHAR) || '|' || l_returnflag), 16) || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS row_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem)")
def stable_ids(spark, sf_dir):
    """P50, W5."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice")
    return publish.stable_row_ids(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_linenumber", "row_id")


@query(
    """WITH e AS (SELECT *, CASE WHEN length(p_name) >= 10 THEN p_name || '::' || p_brand ELSE 'id:' || p_partkey END AS g FROM part)
SELECT arg_max(p_partkey, (NOT (p_size % 5 = 0), p_size, length(p_type), p_partkey)) AS p_partkey, count(*) AS members FROM e GROUP BY g"""
)
def exam_dedup(spark, sf_dir):
    """Best of equal title and organizer."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", (F.col("p_size") % 5 == 0).alias("hub"), "p_size", "p_type")
    best = publish.exam_dedup(p, "p_name", "p_brand", "hub", "p_size", "p_type", "p_partkey")
    key = F.when(F.char_length("p_name") >= 10, F.concat_ws("::", "p_name", "p_brand")).otherwise(F.concat(F.lit("id:"), F.col("p_partkey").cast("string")))
    sizes = p.groupBy(key.alias("g")).agg(F.count("*").alias("members"))
    return best.withColumn("g", key).join(sizes, "g").select("p_partkey", "members")


@query("SELECT o_orderkey FROM orders a WHERE o_orderpriority <> '5-LOW' OR NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderpriority <> '5-LOW' AND b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus)")
def clickbait(spark, sf_dir):
    """Flagged rows with an unflagged twin go."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderpriority") == "5-LOW").alias("bait"))
    return publish.without_clickbait(o, "bait", [["o_custkey", "o_orderstatus"]]).select("o_orderkey")


@query("SELECT n_nationkey % 5 AS pack, sum(s_acctbal) AS elapsed, CAST(sum(s_suppkey % 3) AS BIGINT) AS failures, CAST(sum(s_suppkey % 7) AS BIGINT) AS pending, count(*) AS sources FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def collection_report(spark, sf_dir):
    """H5."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("pack"), "s_acctbal", (F.col("s_suppkey") % 3).alias("f"), (F.col("s_suppkey") % 7).alias("p"))
    return collection.source_report(s, "pack", "s_acctbal", "f", "p")


@query("SELECT user_id, arg_max(value, (ts, event_id % 2, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def merged_history(spark, sf_dir):
    """Newest of two histories."""
    e = table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id")
    old, new = (e.where(F.col("event_id") % 2 == n).drop("event_id") for n in (0, 1))
    return collection.merged_history(old, new, ["user_id"], "ts")


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS changed FROM orders WHERE o_orderkey % 3 <> 0")
def changed_events(spark, sf_dir):
    """Saved rows that differ now, nulls compared as values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    saved = o.where("o_orderkey % 3 <> 0")
    now_ = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return collection.changed_since(saved, now_, "o_orderkey", ["o_orderstatus", "price"]).select("o_orderkey", "changed")


@query("SELECT CASE WHEN r.k IS NULL THEN 'unmatched' WHEN n < 3 THEN 'too_few' ELSE 'rated' END AS gap, count(*) AS cnt FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) r ON c_custkey = r.k GROUP BY 1")
def rating_gaps(spark, sf_dir):
    """Employers by what their rating lacks."""
    from .operators.employers import gap_histogram

    r = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("records"))
    return gap_histogram(table(spark, sf_dir, "customer").select("c_custkey"), r.withColumn("score", F.when(F.col("records") >= 3, 1.0)), "c_custkey")


@query("SELECT o_custkey AS who, count(*) AS rows, min(o_orderkey) AS first FROM orders GROUP BY 1")
def employer_catalog(spark, sf_dir):
    """A18."""
    from .operators.employers import catalog

    return catalog(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), "o_orderkey"), "who", "o_orderkey")


@query(
    """WITH b AS (SELECT o_orderkey AS id, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d, 1 AS pr FROM orders WHERE o_orderkey % 4 <> 3), s AS (SELECT o_orderkey AS id, -o_totalprice AS v, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 - 1 AS INT) AS d, 2 AS pr FROM orders WHERE o_orderkey % 2 = 1),
m AS (SELECT * FROM b UNION ALL SELECT * FROM s) SELECT id, arg_max(v, (d, pr)) AS v, strftime(max(d), '%Y-%m-%d') AS last_verified_at FROM m GROUP BY 1"""
)
def shard_merge(spark, sf_dir):
    """Shards over a baseline, guarded by generation and ownership; the newest wins, a shard at equal times."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias("last_verified_at")
    base = o.where(k % 4 != 3).select(k.alias("id"), (k % 10).alias("source_id"), F.col("o_totalprice").alias("v"), text(day))
    shards = o.where(k % 2 == 1).select(F.when(k % 10 < 5, "a").otherwise("b").alias("pack"), F.lit("g1").alias("base_generation"), k.alias("id"), (k % 10).alias("source_id"), (-F.col("o_totalprice")).alias("v"), text(F.date_add(day, (k % 3 - 1).cast("int"))))
    owned = spark.range(10).select(F.when(F.col("id") < 5, "a").otherwise("b").alias("pack"), F.col("id").alias("source_id"))
    merged = guards.shard_merge(base, shards, owned, "g1")
    if not guards.lost_keys(base, merged, "id").isEmpty():
        raise ValueError("keys of the baseline are lost")
    return merged.select("id", "v", "last_verified_at")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'other baseline' ELSE 'not its source' END AS reason, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 6")
def foreign_rows(spark, sf_dir):
    """Rows that a guarded merge refuses."""
    k = F.col("o_orderkey")
    shards = table(spark, sf_dir, "orders").select(F.lit("a").alias("pack"), F.when(k % 5 == 0, "g0").otherwise("g1").alias("base_generation"), (k % 7).alias("source_id"), "o_orderkey")
    owned = spark.range(6).select(F.lit("a").alias("pack"), F.col("id").alias("source_id"))
    return guards.foreign_rows(shards, owned, "g1").select("reason", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_discount <= 0.09) AND bool_and(l_quantity >= 3))")
def whole_payloads(spark, sf_dir):
    """orders are payloads; one bad line rejects all of one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity")
    rules = {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity") >= 3}
    return guards.valid_payloads(rows, "l_orderkey", rules).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, array_to_string(list_filter([CASE WHEN max(l_discount) > 0.09 THEN 'discount' END, CASE WHEN min(l_quantity) < 3 THEN 'quantity' END], lambda x: x IS NOT NULL), '|') AS reasons, count(*) AS rows FROM lineitem GROUP BY 1 HAVING max(l_discount) > 0.09 OR min(l_quantity) < 3")
def refused_payloads(spark, sf_dir):
    """what is refused, and why."""
    rules = {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity") >= 3}
    found = guards.rejected_payloads(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity"), "l_orderkey", rules)
    return found.select("l_orderkey", F.array_join("reasons", "|").alias("reasons"), "rows")


@query("SELECT l_orderkey AS path, l_suppkey % 3 AS page, CAST(round(l_quantity / 6) * 6 AS INT) AS line, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_extendedprice, CAST(l_partkey AS VARCHAR)) AS cells FROM lineitem GROUP BY ALL")
def word_grid(spark, sf_dir):
    """Words with places become rows of a grid; quantities stand for heights, prices for distances."""
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_suppkey") % 3).alias("page"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_partkey").cast("string").alias("text"))
    return guards.word_rows(words).select("path", "page", "line", F.array_join("cells", "|").alias("cells"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_id % 2 = 0) AS event_type, max(ts) FILTER (event_id % 2 = 0) AS read_at, arg_max(value, (ts, event_id)) FILTER (event_id % 2 = 1) AS value, max(ts) FILTER (event_id % 2 = 1) AS note_at FROM events GROUP BY 1")
def newest_parts(spark, sf_dir):
    """Groups of fields that are newest independently of each other."""
    even = F.col("event_id") % 2 == 0
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(even, F.col("ts")).alias("read_at"), F.when(even, F.col("event_type")).alias("event_type"), F.when(~even, F.col("ts")).alias("note_at"), F.when(~even, F.col("value")).alias("value"))
    return state.newest_parts(e, "user_id", {"read_at": ["event_type"], "note_at": ["value"]}, "event_id").select("user_id", "event_type", "read_at", "value", "note_at")


@query(f"WITH {OPP_SQL} SELECT id, price FROM opp WHERE price > 100000")
def guarded_publication(spark, sf_dir):
    """A candidate that fails a check gives way to the baseline."""
    rows = opportunities(spark, sf_dir).select("id", "price")
    base = rows.where("price > 100000")
    kept, failed = guards.guarded_publication(rows.where("id % 2 = 0"), base, {"rows": F.count("*") > 0, "ids": F.count_if(F.col("id") % 2 == 1) > 0})
    if failed != ["ids"]:
        raise ValueError(f"unexpected checks: {failed}")
    return kept
