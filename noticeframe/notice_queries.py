"""Queries over notices, pages, tables and talks that Spark derives from rows of the star-schema tables.

Each notice is put together from columns of its row (names, brands, sizes, dates), so what an operator must find is what the
row holds, and the SQL takes it from there without any of the operator's rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, table
from .functions import display, facts, talks, text, timeutil, titles
from .functions import organizers as text_organizers
from .operators import bodies, campaigns, changes, collection, companies, examfacts, examtables, extract, places, prose, publish, relational
from .sources import calendars, pages

#: White space that notices hold between words, by row: blank, full-width blank, no-break blank, several, line end.
GAPS = (" ", "　", " ", " 　 ", "\r\n")
GAP_SQL = "CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN chr(12288) WHEN 2 THEN chr(160) WHEN 3 THEN ' ' || chr(12288) || chr(160) ELSE chr(13) || chr(10) END"


def gapped(df, key: str = "p_partkey"):
    return df.withColumn("g", F.element_at(F.array(*[F.lit(g) for g in GAPS]), (F.col(key) % len(GAPS)).cast("int") + 1))


def joined(*parts):
    """Columns by their names and any other text as it is, in a row."""
    named = lambda p: p.isascii() and p.isidentifier()
    return F.concat(*[p if not isinstance(p, str) else F.col(p) if named(p) else F.lit(p) for p in parts])


@query(
    """SELECT p_partkey, p_name AS card_title, p_name AS role, '要求：' || p_name || '；不限，见公告' AS excerpt, p_size || 'k-' || (p_size + 5) || 'k' AS salary, p_size * 1000.0 AS pay_min, '本科 及以上' AS education,
              p_name || ' 馆' AS venue, p_brand || replace(p_name, ' ', '') AS company, '2026-05-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS deadline, p_brand || '|' || p_type AS majors, true AS clean
       FROM part"""
)
def spaced_titles(spark, sf_dir):
    """Full-width and no-break blanks and line ends count as white space in titles, pay, education, days and lists."""
    rows = gapped(relational.dealt(table(spark, sf_dir, "part"), "p_partkey")).withColumn("size", F.col("p_size").cast("string"))
    pay = F.concat("size", F.lit("k-"), (F.col("p_size") + 5).cast("string"), F.lit("k"))
    title = joined("p_brand", "g", "·", "g", "p_name", "g")
    inner = F.when(F.col("p_partkey") % 5 == 4, F.lit(" ")).otherwise(F.col("g"))
    return rows.select(
        "p_partkey",
        titles.card_title(title, F.concat("g", "p_brand", "g")).alias("card_title"),
        titles.role_portion(title, F.col("p_brand")).alias("role"),
        titles.clean_excerpt(joined("g", "要求：", "g", "：", "p_name", "；", "g", "；不限，", "g", "，见公告", "g")).alias("excerpt"),
        display.salary_display(F.concat("p_name", "g", pay, "g"), F.lit(""), F.lit(None).cast("string"))["salary"].alias("salary"),
        facts.salary_range(F.concat("p_name", "g", pay, "g"), F.lit(""))["min"].alias("pay_min"),
        titles.education_display(joined("g", "2026", "g", "届，", "本科", "g", "g", "及以上", "g")).alias("education"),
        titles.venue_display(joined("p_brand", "g", "·", "p_name", "g", "馆", "g"), F.col("p_brand")).alias("venue"),
        text.company_norm(joined("g", "p_brand", "g", F.regexp_replace("p_name", " ", ""), "g", "有限公司")).alias("company"),
        extract.sole_deadline(joined("报名截止：2026", inner, "年", inner, "5", inner, "月", inner, (F.col("p_size") % 28 + 1).cast("string"), "日")).alias("deadline"),
        F.array_join(extract.split_majors(joined("p_brand", "g", "g", "、", "g", "p_type", "g")), "|").alias("majors"),
        (text.trimmed(F.concat("g", "p_name", "g", "g")) == F.col("p_name")).alias("clean"),
    )


@query(
    """SELECT p_brand || '-' || (p_partkey // 7) AS exam_id, '部门' || p_brand AS department, '单位' || p_type AS employer, p_name || '岗' AS position_name, 'C' || p_partkey AS position_code,
              p_size AS recruit_count, CASE WHEN p_partkey % 3 = 0 THEN '本科：' || p_name || '学；研究生：' || p_type || '学' WHEN p_partkey % 3 = 1 THEN p_name || '学' ELSE p_type || '学' END AS major_raw,
              CASE WHEN p_partkey % 2 = 0 THEN '本科' ELSE '硕士' END AS education, CASE WHEN p_size % 2 = 0 THEN '参公管理' ELSE '事业编' END AS bianzhi,
              substring(sha256(p_brand || '-' || (p_partkey // 7) || '|C' || p_partkey || '|单位' || p_type || '|' || p_name || '岗'), 1, 16) AS row_id,
              replace(CASE WHEN p_partkey % 3 = 0 THEN '本科：' || p_name || '学|研究生：' || p_type || '学' WHEN p_partkey % 3 = 1 THEN p_name || '学' ELSE p_type || '学' END, ' ', '|') AS majors
       FROM part"""
)
def exam_tables(spark, sf_dir):
    """E5: positions of one grid per brand and seven parts, under headers of three rows with merged cells, two tiers of majors, titles above and sums below.

    A grid's department is one merged cell over all of its rows.
    """
    rows = table(spark, sf_dir, "part").withColumn("exam_id", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 7).cast("string")))
    k = F.col("p_partkey")
    cells = F.array(
        F.lit(""), F.concat(F.lit("单位"), "p_type"), F.concat("p_name", F.lit("岗")), F.concat(F.lit(" C"), k.cast("string")), F.concat("p_size", F.lit("　人")),
        F.when(k % 2 == 0, "本科").otherwise("硕士"), F.when(k % 3 != 2, F.concat("p_name", F.lit("学"))), F.when(k % 3 != 1, F.concat("p_type", F.lit("学"))), F.when(F.col("p_size") % 2 == 0, "参公").otherwise("财政拨款"),
    )
    lines = lambda *given: F.array(*[F.array(*[F.lit(c) for c in row]) for row in given])
    head = lines(
        ["附件 岗位表", "", ""],
        ["主管部门", "单位名称", "岗位", "", "招聘人数", "学历", "专业要求", "", "经费形式"],
        ["", "", "岗位名称", "岗位代码", "", "学历要求", "大学本科专业要求", "研究生专业要求", ""],
    )
    body = F.array_sort(F.collect_list(F.struct(k.alias("k"), cells.alias("c"))))
    grids = rows.groupBy("exam_id", "p_brand").agg(body.alias("body")).select(
        "exam_id",
        F.concat(head, F.transform("body", lambda r, i: F.when(i == 0, F.concat(F.array(F.concat(F.lit("部门"), "p_brand")), F.slice(r["c"], 2, 8))).otherwise(r["c"])), lines(["合计", "", "9"], ["注：以公告为准"])).alias("grid"),
        F.concat(
            F.array(F.array(*map(F.lit, (0, 0, 1, 9))), *[F.array(*map(F.lit, m)) for m in ((1, 0, 2, 1), (1, 1, 2, 1), (1, 2, 1, 2), (1, 4, 2, 1), (1, 6, 1, 2), (1, 8, 2, 1), (90, 0, 2, 2))]),
            F.array(F.array(F.lit(3), F.lit(0), F.size("body"), F.lit(1))),
        ).alias("merges"),
    )
    found = examtables.exam_positions(grids)
    return found.select("exam_id", "department", "employer", "position_name", "position_code", "recruit_count", "major_raw", "education", "bianzhi", "row_id", F.array_join("majors", "|").alias("majors"))


#: A planted vocabulary: pairs of syllables, and each syllable that is long enough to stand alone.
SYLLABLES = ("eau", "eaux", "tion", "ment", "ent", "que", "elle", "tre", "ouan", "ier", "pa", "ren", "an", "er", "in", "os")
PLANTED = sorted({a + b for a in SYLLABLES for b in SYLLABLES} | {s for s in SYLLABLES if len(s) > 3}, key=lambda w: (-len(w), w))


@query(
    f"SELECT doc_id, CAST(len(f) AS BIGINT) AS n_found, CAST(len(list_distinct(f)) AS BIGINT) AS n_words, sha256(array_to_string(f, ' ')) AS found_sha256 FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{'|'.join(PLANTED)}') AS f FROM documents)"
)
def words_in_prose(spark, sf_dir):
    """A vocabulary's leftmost longest words in whole documents, by one automaton; the SQL tries all words at every place, longest first."""
    found = table(spark, sf_dir, "documents").select("doc_id", prose.words_in(F.col("text"), PLANTED).alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n_found"), F.size(F.array_distinct("f")).cast("long").alias("n_words"), F.sha2(F.array_join("f", " "), 256).alias("found_sha256"))


TYPE_STEMS = ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "LARGE", "SMALL")


@query(
    f"""SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 5 = 0 THEN '专业不限' END, p_type || '学', CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || '科学' END, CASE WHEN p_partkey % 3 = 0 THEN 'x' || p_type || '工程' END,
               CASE WHEN p_partkey % 4 <> 0 THEN p_type || 'b' || CASE WHEN p_partkey % 4 = 1 THEN '类' ELSE '' END END) AS majors FROM part"""
)
def majors_in_prose(spark, sf_dir):
    """The four passes over a notice of each part: no limit in a line, a labelled line, a labelled block that ends at another label, a phrase for related majors."""
    k = F.col("p_partkey")
    when = lambda test, *parts: F.when(test, joined(*parts)).otherwise("")
    body = joined(
        "公告\n职位描述：熟悉", "p_type", "学知识\n", when(k % 5 == 0, "专业要求：不限\n"), "1. 专业要求：全日制", "p_type", "学专业、", "p_type", "学能力、不存在的甲乙、", when(k % 2 == 0, F.lower("p_type"), "科学等相关专业、"), "本科学历。其他学\n",
        when(k % 3 == 0, "【需求专业】\n（1）x", "p_type", "工程专业\n岗位职责：\n", "p_type", "后学\n"),
        when(k % 4 == 1, "；", "p_type", "b类专业\n"), when(k % 4 > 1, "；", "p_type", "b相关专业优先\n"), "学历：硕士\n",
    )
    words = prose.MajorWords(frozenset(f"{t}科学".lower() for t in TYPE_STEMS), TYPE_STEMS)
    return relational.dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.array_join(prose.prose_majors(body, words), "|").alias("majors"))


def order_versions(spark, sf_dir):
    """Every order as a version of its customer's notice: what it says follows from its key, status, price and priority."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    later = lambda n: F.date_format(F.date_add(day, n), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate",
        F.concat(F.lit("招聘"), F.when(k % 7 == 0, "补录").otherwise(""), F.when(k % 5 == 0, "面试").otherwise("")).alias("title"),
        F.concat(F.lit("岗位说明："), "o_orderpriority", F.when(k % 3 == 0, "\n待遇：从优办理").otherwise("")).alias("body"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, later(400)).otherwise(later(60)).alias("deadline"),
        (k % 3).cast("int").alias("position_count"),
        F.array("o_orderstatus").alias("majors"),
        F.when(k % 6 == 0, F.array("o_orderpriority", F.lit("总部"))).when(k % 6 == 1, F.array(F.lit("总部"))).otherwise(F.array("o_orderpriority")).alias("cities"),
        F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("https://a.cn/"), (k % 2).cast("string"), F.lit("/campus/detail?jobAdId="), k.cast("string"))).alias("application_url"),
        F.array(F.lit("报名表"), F.concat(F.lit("附件"), (k % 9).cast("string"))).alias("attachments"),
        F.when(k % 2 == 0, "本科").otherwise("硕士").alias("education"),
        F.when(k % 10 == 0, "仅核实标题").alias("note"),
        F.lit("招聘").alias("kind"),
        F.date_format(F.date_add(day, (k % 5 - 2).cast("int")), "yyyy-MM-dd").alias("published_at"),
    )


def _order_changes() -> str:
    """The nine detectors and the lock over two versions, each a column of its own; the lock is a recursion over a customer's versions."""
    later = lambda n: f"strftime(CAST(o_orderdate AS DATE) + INTERVAL {n} DAY, '%Y-%m-%d')"
    names = "title body deadline pc major cities url att edu stub".split()
    lags = ", ".join(f"lag({c}) OVER w AS o_{c}" for c in names)
    return rf"""
WITH RECURSIVE v AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS d, '招聘' || CASE WHEN o_orderkey % 7 = 0 THEN '补录' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '面试' ELSE '' END AS title,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '+' ELSE o_orderpriority END AS body, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN {later(400)} ELSE {later(60)} END AS deadline, o_orderkey % 3 AS pc, o_orderstatus AS major,
       list_sort(CASE o_orderkey % 6 WHEN 0 THEN [o_orderpriority, '总部'] WHEN 1 THEN ['总部'] ELSE [o_orderpriority] END) AS cities, CASE WHEN o_orderkey % 8 = 0 THEN -1 ELSE o_orderkey % 2 END AS url, o_orderkey % 9 AS att,
       CASE WHEN o_orderkey % 2 = 0 THEN '本科' ELSE '硕士' END AS edu, o_orderkey % 10 = 0 AS stub, {later('(o_orderkey % 5 - 2)')} AS pub FROM orders),
p AS (SELECT *, row_number() OVER w AS rev, strftime(first_value(o_orderdate) OVER w, '%Y-%m-%d') AS seen, {lags} FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT o_custkey, rev, seen, pub AS published FROM p WHERE rev = 1 UNION ALL
      SELECT p.o_custkey, p.rev, p.seen, CASE WHEN k.published > p.seen THEN p.seen WHEN p.pub > k.published THEN k.published ELSE p.pub END FROM k JOIN p ON p.o_custkey = k.o_custkey AND p.rev = k.rev + 1),
x AS (SELECT *, list_sort(list_filter(cities, lambda c: NOT list_contains(o_cities, c))) AS more, list_sort(list_filter(o_cities, lambda c: NOT list_contains(cities, c))) AS less, array_to_string(cities, '、') AS every,
             o_deadline <> '' AND deadline > o_deadline AND date_diff('day', d, TRY_CAST(deadline AS DATE)) >= 330 AND date_diff('day', d, TRY_CAST(nullif(o_deadline, '') AS DATE)) >= 300 AND date_diff('day', TRY_CAST(nullif(o_deadline, '') AS DATE), TRY_CAST(nullif(deadline, '') AS DATE)) <= 14 AS rolls
      FROM p WHERE rev > 1),
c AS (SELECT *, list_filter([
  CASE WHEN o_deadline <> '' AND deadline > o_deadline AND NOT coalesce(rolls, false) THEN 'deadline_extended|截止延期|报名截止时间延长至 ' || deadline || '（原截止时间：' || o_deadline || '）'
       WHEN o_deadline = '' AND deadline <> '' THEN 'deadline_extended|明确截止时间|明确报名截止时间为 ' || deadline
       WHEN deadline <> '' AND deadline < o_deadline THEN 'deadline_extended|截止调整|报名截止时间调整为 ' || deadline || '（原截止时间：' || o_deadline || '）' END,
  CASE WHEN contains(title, '补录') AND NOT contains(o_title, '补录') THEN 'supplemental|补录招募|招聘变更为补录 / 追加招聘批次' END,
  CASE WHEN contains(title, '面试') AND NOT contains(o_title, '面试') THEN 'selection_stage|考核进展|发布笔试/面试或录用公示通知' END,
  CASE WHEN pc = o_pc AND major = o_major THEN NULL
       WHEN o_stub AND o_pc = 0 AND pc > 0 THEN 'positions_updated|岗位表就绪|首次提取 ' || pc || ' 个职位' || CASE WHEN major <> o_major THEN '，新增专业：' || major ELSE '' END
       WHEN pc < o_pc AND major = o_major THEN 'positions_updated|岗位缩减|岗位数量缩减为 ' || pc || ' 个职位（原 ' || o_pc || ' 个）'
       ELSE 'positions_updated|岗位表更新|岗位需求变动为 ' || pc || ' 个职位' || CASE WHEN major <> o_major THEN '，新增专业：' || major ELSE '' END END,
  CASE WHEN len(more) = 0 AND len(less) = 0 THEN NULL WHEN o_stub AND len(more) > 0 THEN 'content_updated|地点补全|首次补全工作地点「' || every || '」'
       WHEN len(less) = 0 THEN 'content_updated|地点调整|工作地点新增「' || array_to_string(more, '、') || '」'
       WHEN len(more) > 0 THEN 'content_updated|地点调整|工作地点调整为「' || every || '」（新增' || array_to_string(more, '、') || '）' ELSE 'content_updated|地点调整|工作地点调整为「' || every || '」' END,
  CASE WHEN url = o_url THEN NULL WHEN url = -1 THEN 'content_updated|入口更新|网申投递方式调整' WHEN o_url = -1 THEN 'content_updated|入口更新|新增网申投递入口' ELSE 'content_updated|入口更新|网申投递入口已更新为最新链接' END,
  CASE WHEN att <> o_att THEN 'content_updated|附件变动|新增/更新附件「附件' || att || '」' END,
  CASE WHEN edu <> o_edu THEN 'content_updated|资格调整|学历要求调整为「' || edu || '」（原要求：' || o_edu || '）' END], lambda s: s IS NOT NULL) AS found FROM x),
e AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN coalesce(rolls, false) OR (url = -1 AND o_url = -1 AND body = o_body AND title = o_title) THEN [] WHEN rtrim(body, '+') <> rtrim(o_body, '+') AND ends_with(body, '+') AND NOT ends_with(o_body, '+') THEN ['content_updated|内容更新|公告正文补充薪酬福利与待遇说明']
             WHEN rtrim(body, '+') <> rtrim(o_body, '+') THEN ['content_updated|内容更新|正文变动：补充「岗位说明：' || rtrim(body, '+') || '」'] WHEN ends_with(body, '+') AND NOT ends_with(o_body, '+') THEN ['content_updated|内容更新|公告正文补充薪酬福利与待遇说明']
             ELSE ['content_updated|内容更新|招聘公告正文说明已同步最新修订'] END AS said FROM c),
f AS (SELECT o_custkey, o_orderkey, rev, split_part(said[1], '|', 1) AS change, split_part(said[1], '|', 2) AS label, array_to_string(list_transform(said[1:2], lambda s: split_part(s, '|', 3)), '；') AS detail FROM e WHERE len(said) > 0
      UNION ALL SELECT o_custkey, o_orderkey, rev, CASE WHEN contains(title, '补录') THEN 'supplemental' ELSE 'selection_stage' END, CASE WHEN contains(title, '补录') THEN '补录招募' ELSE '考核进展' END,
             CASE WHEN contains(title, '补录') THEN '启动补录 / 追加招聘批次' ELSE '发布考核选拔或录用进展通知' END FROM p WHERE rev = 1 AND (contains(title, '补录') OR contains(title, '面试')))
SELECT o_orderkey, CAST(rev AS INT) AS revision, change, label, detail, published FROM f JOIN k USING (o_custkey, rev)"""


@query(_order_changes())
def notice_changes(spark, sf_dir):
    """Nine detectors between versions of each customer's notice, and the locked publication of each."""
    found = changes.change_log(order_versions(spark, sf_dir), "o_custkey", "o_orderdate", "o_orderkey")
    return found.select("o_orderkey", "revision", F.col("change.type").alias("change"), F.col("change.title").alias("label"), F.col("change.detail").alias("detail"), "published")


_TEXT = "trim(array_to_string(string_split_regex(coalesce(text, ''), '\r?\n'), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279))"


@query(
    f"""WITH s AS (SELECT doc_id, unnest([{{'sec': 0, 'heading': NULL, 'label': NULL, 'content': '来源' || source}}, {{'sec': 1, 'heading': '一、' || source || '简介', 'label': '一、' || source || '简介', 'content': {_TEXT}}},
                   {{'sec': 2, 'heading': '（二）报名', 'label': '二、报名', 'content': ''}}, {{'sec': 3, 'heading': '【' || lang || '说明】', 'label': '【' || lang || '说明】', 'content': lang || chr(10) || n_chars}}], recursive := true) FROM documents)
        SELECT doc_id, CAST(sec AS INT) AS section, heading, substring(label, 1, 10) AS label, sha256(content) AS content_sha256 FROM s"""
)
def document_sections(spark, sf_dir):
    """Sections of an announcement around every whole document."""
    body = F.concat(
        F.lit("来源"), "source", F.lit("\r\n　一、"), "source", F.lit("简介 \n"), F.coalesce("text", F.lit("")), F.lit("\n（二）报名\n\n 【"), "lang", F.lit("说明】\n"), "lang", F.lit("\n"), F.col("n_chars").cast("string")
    )
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(bodies.announcement_sections(body)).alias("section", "s"))
    return found.select("doc_id", "section", "s.heading", "s.label", F.sha2("s.content", 256).alias("content_sha256"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '硕士' WHEN p_partkey % 3 = 1 THEN '本科及以上' END AS education, CASE WHEN p_partkey % 2 = 0 THEN '2026-05-01' END AS deadline,
              CASE WHEN p_partkey % 4 = 0 THEN p_brand || '园区' END AS place,
              concat_ws('|', CASE WHEN p_partkey % 5 = 0 THEN '招聘单位=' || p_type END, CASE WHEN p_partkey % 7 = 0 THEN '工作性质=全职' END, '岗位类别=' || p_type, '招聘人数=' || p_size || '人') AS meta,
              '~' || 'paragraph:' || p_name || '介绍' || '#岗位职责~list+:' || p_name || '一；;' || p_type || '二#任职要求~list+:熟悉' || p_brand || CASE WHEN p_partkey % 3 = 1 THEN ';学历：本科及以上' ELSE '' END || '~list-:' || p_type || '#福利待遇~roles:' || p_name || ';' || p_brand || '~paragraph:完' AS sections,
              p_partkey % 6 = 0 AS disclaimed FROM part"""
)
def structured_bodies(spark, sf_dir):
    """Facts, other fields, sections and blocks of a notice of each part."""
    k = F.col("p_partkey")
    when = lambda test, *parts: F.when(test, joined(*parts)).otherwise("")
    size = F.col("p_size").cast("string")
    body = joined(
        when(k % 2 == 0, "招聘信息\n标题\n", "p_name", "\n招聘截止日期\n2026-05-01\n\n应聘网址\nhttps://a.cn\n"),
        "公司名称：", F.when(k % 5 == 0, F.col("p_type")).otherwise(F.concat("p_brand", F.lit("公司"))), "\n职位名称：", "p_name", "（编号：AB12345）\n",
        when(k % 4 == 0, "工作地点：：", "p_brand", "园区；\n"), when(k % 4 == 1, "工作城市：山东省济南市\n"), when(k % 7 == 0, "工作性质：全职\n"), when(k % 7 == 1, "招聘类型：2026届校园招聘\n"),
        when(k % 3 == 0, "学历要求：硕士\n"), "职位类别：", "p_type", "\n需求人数：", size, "\n薪资：面议\n", "p_name", "介绍\n岗位职责：1. ", "p_name", "一；2. ", "p_type", "二\n三、任职要求：\n".replace("三、", ""),
        "（1）熟悉", "p_brand", "\n", when(k % 3 == 1, "2、学历：本科及以上\n"), "· ", "p_type", "\n【福利待遇】\n岗位：", "p_name", "\n岗位: ", "p_brand", "\n岗位：", "p_name", "\n完\n", when(k % 6 == 0, "\n此条为第三方公开招聘线索，请打开来源核对投递方式。\n"),
    )
    known = {"company": F.col("p_brand"), "title": F.concat("p_name", F.lit("岗")), "cities": F.array(F.lit("济南")), "education": F.lit("未明确"), "deadline": F.lit(""), "types": F.array(F.lit("校招")), "years": F.array(F.lit("2026"))}
    found = relational.dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", bodies.structured_body(body, **known).alias("b"))
    of_block = lambda b: F.concat(b["type"], F.when(b["ordered"], "+").when(~b["ordered"], "-").otherwise(""), F.lit(":"), F.array_join(b["items"], ";"))
    sections = F.array_join(F.transform("b.sections", lambda s: F.concat(F.coalesce(s["label"], F.lit("")), F.lit("~"), F.array_join(F.transform(s["blocks"], of_block), "~"))), "#")
    return found.select(
        "p_partkey", "b.education", "b.deadline", "b.place", F.array_join(F.transform("b.meta", lambda m: F.concat_ws("=", m["label"], m["value"])), "|").alias("meta"), sections.alias("sections"), F.col("b.disclaimer").isNotNull().alias("disclaimed")
    )


@query(
    """SELECT c_custkey, concat_ws('|', n_name, CASE WHEN n_name <> '济南' THEN '济南' END, c_mktsegment) AS chips, 2 AS prioritized FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def place_order(spark, sf_dir):
    """Places of a customer's notices, the wanted one first, then near ones."""
    c, n = (table(spark, sf_dir, t) for t in ("customer", "nation"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    shown = bodies.place_chips(F.array("c_mktsegment", F.lit(" 济南　"), "n_name", "c_mktsegment", F.lit("")), F.array("n_name"), ["济南", "青岛"])
    return rows.select("c_custkey", F.array_join(shown["chips"], "|").alias("chips"), shown["prioritized"].alias("prioritized"))


#: A name in Chinese characters for each digit, so that keys become names of people's offices and companies.
DIGITS, HAN = "0123456789", "甲乙丙丁戊己庚辛壬癸"


def han(key: str):
    return F.translate(F.col(key).cast("string"), DIGITS, HAN)


@query(
    f"""SELECT s_suppkey, '2026年' || h || CASE s_suppkey % 8 WHEN 0 THEN '教育局公开招聘' WHEN 1 THEN '县教育系统招聘' WHEN 2 THEN '市市直事业单位招聘' WHEN 3 THEN '号公告' WHEN 4 THEN '号来了' WHEN 5 THEN '号说明' WHEN 6 THEN '北部战区陆军文职' ELSE '号省属单位' END AS title,
              CASE s_suppkey % 8 WHEN 0 THEN h || '教育局' WHEN 1 THEN h || '县教育和体育局' WHEN 2 THEN h || '市人力资源和社会保障局' WHEN 3 THEN h || '市甲级医院' WHEN 4 THEN s_name WHEN 5 THEN '源' || s_nationkey WHEN 6 THEN '北部战区陆军' ELSE '山东省人力资源和社会保障厅' END AS organizer
       FROM (SELECT *, '东' || translate(CAST(s_suppkey AS VARCHAR), '{DIGITS}', '{HAN}') AS h FROM supplier)"""
)
def organizers(spark, sf_dir):
    """Clean titles and organizers of a notice of each supplier: named in the title, by a place's sector, in the introduction, by its fields, by a general rule."""
    k, h = F.col("s_suppkey") % 8, F.concat(F.lit("东"), han("s_suppkey"))
    tails = ("教育局公开招聘", "县教育系统招聘", "市市直事业单位招聘", "号公告", "号来了", "号说明", "北部战区陆军文职", "号省属单位")
    title = joined("主题：", "2026年", h, F.element_at(F.array(*map(F.lit, tails)), (k + 1).cast("int")), "　日期：")
    body = F.when(k == 3, joined("一、单位简介\n", h, "市甲级医院是一所综合医院")).otherwise("各位考生")
    company = F.when(k == 4, F.col("s_name")).when(k == 5, "济南人社")
    source = F.when(k == 7, "未知 · 转载").otherwise(F.concat(F.lit("源"), F.col("s_nationkey").cast("string"), F.lit(" · 公告")))
    return relational.dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", text_organizers.exam_title(title).alias("title"), text_organizers.organizer(title, company, body, source).alias("organizer"))


@query(
    f"""WITH n AS (SELECT o_custkey, count(*) AS texts, count(*) FILTER (o_orderkey % 3 = 0) AS says_own, count(*) FILTER (o_orderkey % 3 = 1) AS says_other, count(*) FILTER (o_orderkey % 6 = 5) AS names_own FROM orders GROUP BY 1),
        c AS (SELECT *, translate(CAST(o_custkey AS VARCHAR), '{DIGITS}', '{HAN}') AS h, o_custkey % 5 = 4 AS coded FROM n)
        SELECT o_custkey, CASE WHEN coded AND (says_own > 0) = (says_other > 0) THEN '' WHEN says_own > 0 OR (NOT coded AND names_own > 0) THEN '东方' || h || '有限公司' WHEN says_other > 0 THEN '西方' || h || '有限公司' ELSE '' END AS company,
               coded OR (names_own = 0 AND says_own = 0) AS company_conflict FROM c"""
)
def company_facts(spark, sf_dir):
    """Companies of customers from the texts of all their orders: agreement, contradiction, absence, and codes in place of names."""
    k, h = F.col("o_orderkey"), han("o_custkey")
    own, other = joined("东方", h, "有限公司"), joined("西方", h, "有限公司")
    title = F.when(k % 3 == 0, joined("2026年度", own, "招聘")).when(k % 3 == 1, joined("【急】", other, "校园招聘")).otherwise("岗位信息汇总")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", F.when(F.col("o_custkey") % 5 == 4, F.lpad(F.col("o_custkey").cast("string"), 18, "0")).otherwise(own).alias("company"), title.alias("title"),
        F.when(k % 6 == 5, joined("欢迎加入", own, "。")).otherwise("详见附件").alias("body"), F.lit("招聘公告").alias("kind"), F.lit("a-announcements").alias("source_id"), F.lit("网站").alias("source_name"),
    )
    return companies.company_facts(rows, "o_custkey").select("o_custkey", "company", "company_conflict")


@query(
    """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, sum(CASE WHEN l_quantity <= 45 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS heads, bool_or(l_linenumber = 5) AS free, bool_or(l_orderkey % 2 = 1) AS told FROM lineitem WHERE l_orderkey % 4 < 2 GROUP BY 1)
       SELECT o_orderkey, CASE WHEN p.k IS NOT NULL THEN CASE WHEN told THEN 'parsed' ELSE 'prose' END WHEN o_orderkey % 4 = 2 THEN 'attachment_only' ELSE 'none' END AS positions_status,
              nullif(greatest(coalesce(n, 0), CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 90 ELSE 0 END), 0) AS total_positions,
              nullif(greatest(coalesce(heads, 0), CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 700 + 1 ELSE 0 END, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 50 + 1 ELSE 0 END), 0) AS total_headcount,
              coalesce(free, false) OR o_orderkey % 7 = 0 AS unlimited, CASE WHEN o_orderkey % 2 = 0 THEN '1:' || (o_orderkey % 5 + 1) END AS exam_ratio, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 30 + 20) || '周岁及以下' END AS age_limit,
              CASE WHEN o_orderkey % 7 = 1 THEN '最低服务年限五年' END AS service_years, CASE o_orderkey % 11 WHEN 0 THEN '部分岗位限本地户籍/生源' WHEN 1 THEN '不限户籍' ELSE '' END AS hukou, CASE WHEN o_orderkey % 13 = 0 THEN '限应届优秀高校毕业生' ELSE '' END AS fresh_grads,
              CASE WHEN o_orderkey % 13 = 0 THEN '要求中共党员（含预备党员）或主要学生干部' ELSE '' END AS party, CASE o_orderkey % 6 WHEN 0 THEN '本科及以上' WHEN 1 THEN '硕士研究生及以上' WHEN 2 THEN '专科及以上' WHEN 3 THEN '博士研究生' ELSE '' END AS education
       FROM orders LEFT JOIN p ON p.k = o_orderkey"""
)
def exam_enrichment(spark, sf_dir):
    """Every order as an examination, its line items as positions, two attachments each for some: status, totals and conditions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    when = lambda test, *parts: F.when(test, joined(*parts)).otherwise("")
    number = lambda n: n.cast("string")
    levels = F.element_at(F.array(*map(F.lit, ("学历：本科及以上", "硕士学位", "高中", "招聘博士", "", ""))), (k % 6 + 1).cast("int"))
    exams = o.select(
        "o_orderkey", joined("考试公告", when(k % 13 == 0, "选调"), when(k % 5 == 0, "（", number(c % 50 + 1), "人）")).alias("title"),
        joined(
            when(k % 3 == 0, "计划招聘工作人员　", number(c % 700 + 1), "　名，共", number(c % 90), "个岗位。"), when(k % 7 == 0, "专业不限。"), when(k % 2 == 0, "开考比例为1 ：", number(k % 5 + 1), "。年龄不超过", number(c % 30 + 20), "周岁以下。"),
            when(k % 7 == 1, "最低服务年限为五年。"), when(k % 11 == 0, "限本市户籍。\n"), when(k % 11 == 1, "\n户籍不限。\n"), levels,
        ).alias("body"),
    )
    positions = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 < 2").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).otherwise(9999).cast("int").alias("recruit_count"),
        F.when(F.col("l_linenumber") == 5, "不限").otherwise("法学").alias("major_raw"), F.when(F.col("l_orderkey") % 2 == 0, "prose").otherwise("table").alias("source"),
    )
    files = o.where("o_orderkey % 4 <> 3").select("o_orderkey", F.explode(F.array(F.lit("报名表"), F.when(k % 4 == 2, "岗位一览表"))).alias("title"))
    return examfacts.enriched_exams(exams, positions, files, "o_orderkey")


def calendar_pages(spark, sf_dir):
    """Suppliers as talks, five or so to a page, in four shapes of JSON; some pages are broken, refused, empty or of no known shape."""
    k = F.col("s_suppkey")
    stamp = lambda hour: F.concat(F.lit("2026-03-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lit(f" {hour}:30:00"))
    name, key = F.col("s_name"), k.cast("string")
    row = F.struct(
        key.alias("career_talk_id"), F.substring(stamp("09"), 1, 10).alias("meet_day"), name.alias("meet_name"), F.lit("09:30").alias("meet_time"), (k % 2).cast("int").alias("is_yun"), F.concat(F.lit("楼"), key).alias("address"), F.when(k % 3 == 0, 1).alias("career_state"),
        F.concat(F.lit("i"), key).alias("id"), F.concat(F.lit("/t/"), key).alias("url"), name.alias("title"), stamp("09").alias("startTime"), stamp("11").alias("endTime"), F.when(k % 2 == 0, F.concat(F.lit("楼"), key)).alias("fieldExport"), F.concat(F.lit("场"), key).alias("place"),
        F.when(k % 3 == 0, "线上").otherwise("线下").alias("fairTypeName"), key.alias("xjhid"), name.alias("xjhmc"), F.substring(stamp("09"), 1, 10).alias("jbrq"), F.lit("甲校").alias("jbxx"), F.lit("9:30-11:30").alias("kssjd"), F.concat(F.lit("楼"), key).alias("jbdd"),
        F.lit("x").alias("unknown_field"),
    )
    pages = table(spark, sf_dir, "supplier").groupBy(F.floor(k / 5).alias("page")).agg(F.array_sort(F.collect_list(F.struct(k, row.alias("r")))).alias("rows"))
    page, n, items = F.col("page"), F.size("rows"), F.transform("rows", lambda x: x["r"])
    shapes = [
        F.to_json(F.struct(F.when(page % 9 == 8, 0).otherwise(1).alias("code"), items.alias("data"))),
        F.to_json(F.struct(F.lit(1).alias("state"), F.struct(items.alias("list")).alias("object"))),
        F.to_json(F.struct(F.lit(1).alias("state"), F.struct(items.alias("list"), F.lit(2).alias("totalPage"), n.alias("count")).alias("object"))),
        F.to_json(F.struct(F.lit(200).alias("code"), F.lit(True).alias("success"), F.struct(items.alias("records"), n.alias("total")).alias("result"))),
    ]
    names = list(calendars.FORMATS)
    body = F.when(page % 10 == 9, F.lit('{"code": 1, "data": [')).otherwise(F.element_at(F.array(*shapes), (page % 4 + 1).cast("int")))
    kind = F.when(page % 11 == 10, "other").otherwise(F.element_at(F.array(*map(F.lit, names)), (page % 4 + 1).cast("int")))
    return pages.select("page", kind.alias("format"), body.alias("body"), F.lit("https://a.cn").alias("base"), F.when(page % 7 == 6, "乙校").otherwise("甲校").alias("school"), F.lit("c1").alias("code"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS page, s_name, '2026-03-' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS day FROM supplier),
       p AS (SELECT DISTINCT page, CASE WHEN page % 11 = 10 THEN 'unknown' WHEN page % 10 = 9 THEN 'broken' WHEN page % 4 = 0 AND page % 9 = 8 THEN 'refused' WHEN page % 4 = 3 AND page % 7 = 6 THEN 'refused' ELSE 'event' END AS status FROM s)
       SELECT page, status, CASE page % 4 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 3 THEN 'c1:' || k ELSE 'i' || k END AS identity,
              'https://a.cn' || CASE page % 4 WHEN 0 THEN '/detail/career?id=' || k WHEN 3 THEN '/sub-station/lectureDetail?xxdm=c1&xjhid=' || k ELSE '/t/' || k END AS url, CASE WHEN page % 4 = 0 AND k % 3 = 0 THEN '已取消：' ELSE '' END || s_name AS title,
              day, '09:30' AS starts, CASE WHEN page % 4 <> 0 THEN '11:30' END AS ends, CASE WHEN page % 7 = 6 THEN '乙校' ELSE '甲校' END AS school,
              CASE page % 4 WHEN 0 THEN CASE WHEN k % 2 = 1 THEN '线上宣讲 ' ELSE '' END || '楼' || k WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '楼' || k ELSE '' END WHEN 2 THEN CASE WHEN k % 3 = 0 THEN '线上宣讲 · ' ELSE '' END || CASE WHEN k % 2 = 0 THEN '楼' ELSE '场' END || k ELSE '楼' || k END AS venue, 'x' AS kept
       FROM s JOIN p USING (page) WHERE status = 'event'
       UNION ALL SELECT page, status, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE status <> 'event'"""
)
def calendar_formats(spark, sf_dir):
    """Talks of suppliers from calendars in four JSON shapes; a field that no rule names is kept."""
    found = calendars.calendar_rows(calendar_pages(spark, sf_dir))
    return found.select("page", "status", *calendars.EVENT, F.get_json_object("raw", "$.unknown_field").alias("kept"))


@query(
    """WITH j AS (SELECT o_orderkey AS id, o_custkey AS firm, o_orderkey % 3 = 0 AS talk, year(o_orderdate) AS y, o_orderkey % 5 = 0 AS both, CASE o_orderkey % 4 WHEN 0 THEN '春' WHEN 1 THEN '秋' END AS phase FROM orders),
       m AS (SELECT t.id AS talk_id, c.id AS campaign_id, CAST(t.y = c.y AND t.both = c.both AS INT) AS same FROM j AS t JOIN j AS c ON t.firm = c.firm AND t.talk AND NOT c.talk AND (t.phase IS NULL OR c.phase IS NULL OR t.phase = c.phase)
             AND (t.y = c.y OR (t.both AND t.y + 1 = c.y) OR (c.both AND c.y + 1 = t.y)) WHERE t.id % 6 <> 3),
       r AS (SELECT *, count(*) OVER (PARTITION BY talk_id, same) AS n, max(same) OVER (PARTITION BY talk_id) AS best FROM m)
       SELECT talk_id, campaign_id FROM r WHERE same = best AND n = 1"""
)
def talk_campaigns(spark, sf_dir):
    """Orders of a customer as talks and campaigns: a shared class, phases that don't differ, then the unique best."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    years = F.when(k % 5 == 0, F.array((year + 1).cast("string"), year.cast("string"))).otherwise(F.array(year.cast("string")))
    jobs = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "a-talks").otherwise("a").alias("source_id"), F.lit("招聘公告").alias("kind"), F.concat(F.lit("公告"), F.when(k % 4 == 0, "春招").when(k % 4 == 1, "秋季招聘").otherwise("")).alias("title"),
        F.when(k % 3 == 0, joined(han("o_custkey"), "集团有限公司")).otherwise(joined("子", han("o_custkey"), "公司")).alias("company"), F.when(k % 3 == 0, "").otherwise(joined("子", han("o_custkey"), "公司（简称“", han("o_custkey"), "集团有限公司”）")).alias("body"),
        F.array(F.lit("校招")).alias("types"), years.alias("years"), (k % 6 != 3).alias("has_event"),
    )
    return campaigns.attached_talks(jobs)


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(65279)"


@query(
    f"""SELECT doc_id, CASE WHEN length(text) > 90 THEN rtrim(substring(text, 1, 89), {_WS}) || '…' ELSE text END AS excerpt,
               sha256(substring(trim(substring(lower(source || ' ' || lang), 1, 240) || ' ' || substring(text, 1, 320), {_WS}), 1, 480)) AS search_sha256,
               regexp_matches(lower(text), '(?:^|[^a-z0-9])le(?:$|[^a-z0-9])') AS says_le, contains(lower(text), 'ñ') AS says_tilde,
               sha256(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(13) || chr(10), '\\n'), chr(13), '\\n'), chr(10), '\\n')) AS ics_sha256,
               round(len(list_intersect(list_distinct(string_split(source, '')), list_distinct(string_split(lang, '')))) / least(len(list_distinct(string_split(source, ''))), len(list_distinct(string_split(lang, '')))), 6) AS overlap
        FROM documents"""
)
def document_display(spark, sf_dir):
    """Display, search and calendar forms of whole documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.trimmed_excerpt(t).alias("excerpt"), F.sha2(text.search_head_tail(F.concat_ws(" ", "source", "lang"), t), 256).alias("search_sha256"), text.has_keyword(t, "le").alias("says_le"), text.has_keyword(t, "ñ").alias("says_tilde"),
        F.sha2(text.ics_escaped(t), 256).alias("ics_sha256"), F.round(text.char_overlap(F.col("source"), F.col("lang")), 6).alias("overlap"),
    )


@query(
    """WITH o AS (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, DATE '1998-06-01' AS now FROM orders),
       f AS (SELECT *, d + CAST(k % 5 - 2 AS INT) AS pub, strftime(d, '%Y-%m-%d') AS day FROM o)
       SELECT k AS o_orderkey, CASE WHEN pub > now THEN '' WHEN pub > d THEN CASE WHEN k % 3 = 0 THEN strftime(d - 1, '%Y-%m-%d') ELSE day END ELSE strftime(pub, '%Y-%m-%d') END AS healed,
              greatest(day, CASE WHEN k % 2 = 0 AND d + 9 <= now THEN strftime(d + 9, '%Y-%m-%d') ELSE '' END) AS sort_day,
              CASE WHEN k % 7 = 0 THEN 'closed' WHEN k % 4 <> 0 AND d + 60 < now THEN 'closed' WHEN k % 3 = 0 THEN 'unconfirmed' WHEN k % 3 = 1 THEN 'long_term' WHEN date_diff('day', d, now) BETWEEN 0 AND 30 THEN 'confirmed_open' ELSE 'unconfirmed' END AS validity,
              d BETWEEN now - 30 AND now + 1 AS recent, strftime(d, '%Y-%m-%d') || CASE k % 3 WHEN 0 THEN ' 15:59:00' WHEN 1 THEN ' 01:30:00' ELSE ' 08:05:00' END AS ends,
              CASE WHEN d + 1500 >= DATE '2000-01-01' THEN strftime(d + 1500, '%Y-%m-%d') || ' 00:00:00' END AS epoch,
              CASE WHEN k % 4 = 0 THEN '2024|2025' ELSE CAST(2024 + k % 7 AS VARCHAR) END AS years,
              CASE WHEN o_totalprice / 5000 <= 5 THEN 5 WHEN o_totalprice / 5000 <= 10 THEN 10 ELSE 100 END AS scale, k % 5 = 0 AND k % 2 = 0 AS nationwide,
              CASE k % 4 WHEN 0 THEN 'domestic' WHEN 1 THEN 'mixed' WHEN 2 THEN 'overseas' ELSE 'unknown' END AS home, CASE k % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' ELSE 'unknown' END AS employment,
              CASE WHEN k % 11 = 0 THEN 'expired' WHEN k % 11 = 1 THEN 'unconfirmed' WHEN d < now THEN 'expired' WHEN k % 5 = 0 THEN 'extended' WHEN k % 5 = 1 THEN 'supplemental' WHEN d - now BETWEEN 0 AND 3 THEN 'expiring_soon' ELSE 'accepting' END AS stage,
              CASE WHEN k % 2 = 0 THEN '延至' || day END AS alert, year(d) || '年' || month(d) || '月' || day(d) || '日 9:30–11:00' AS label, CASE WHEN k % 3 = 0 THEN 'clarified' ELSE 'extended' END AS moved, k % 3 = 0 AS rolls,
              CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '校招' ELSE '' END AS types, (k % 9 + 1) * CASE WHEN k % 9 >= 4 THEN 1000.0 ELSE 12000.0 END AS pay,
              k % 4 IN (0, 1, 3) AS for_bachelor, k % 4 IN (0, 2, 3) AS for_master
       FROM f"""
)
def notice_facts(spark, sf_dir):
    """Facts of notices whose texts and times follow from each order."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    moment = F.lit("1998-06-01 04:00:00").cast("timestamp")
    on = lambda n: F.date_format(F.date_add(d, n) if isinstance(n, int) else F.date_add(d, n), "yyyy-MM-dd")
    day, none = on(0), F.lit(None).cast("string")
    pick = lambda n, *options: F.element_at(F.array(*[o if not isinstance(o, str) else F.lit(o) for o in options]), (k % n + 1).cast("int"))
    change, moved = F.lit("deadline_extended"), joined("延长至 ", F.date_format(F.date_add(d, 400), "yyyy-MM-dd"), "（原截止时间：", F.date_format(F.date_add(d, F.when(k % 3 == 0, 390).otherwise(60)), "yyyy-MM-dd"), "）")
    clock = pick(3, none, F.lit("09:30"), F.lit("16:05"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        facts.healed_publication(on((k % 5 - 2).cast("int")), day, F.when(k % 3 == 0, F.array(on(-1), on(3))), moment).alias("healed"),
        facts.effective_day(day, k % 2 == 0, on(9), F.lit("1998-06-01")).alias("sort_day"),
        facts.validity(F.when(k % 4 == 0, "").otherwise(on(60)), F.when(k % 7 == 0, "withdrawn").otherwise("active"), pick(3, "open", "long_term", "open"), k % 3 != 0, F.concat(day, F.lit("T04:00:00Z")), none, moment).alias("validity"),
        timeutil.recent(F.concat(day, F.lit("T04:00:00Z")), moment).alias("recent"),
        F.date_format(timeutil.event_end(day, clock, clock), "yyyy-MM-dd HH:mm:ss").alias("ends"),
        F.date_format(timeutil.source_epoch(F.unix_seconds(F.date_add(d, 1500).cast("timestamp")).cast("double") * F.when(k % 2 == 0, 1000).otherwise(1), F.lit("2020-01-01").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("epoch"),
        F.array_join(facts.graduation_years(F.when(k % 4 == 0, "面向2025届和24届").otherwise(F.concat(F.lit("招收"), (2024 + k % 7).cast("string"), F.lit("　届")))), "|").alias("years"),
        titles.score_scale(F.col("o_totalprice") / 5000).alias("scale"),
        publish.nationwide(F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")), F.when(k % 2 == 0, "各地招聘").otherwise("招聘")).alias("nationwide"),
        titles.domestic_status(F.array(pick(4, "甲地", "美国", "英国", "甲地")), F.when(k % 4 < 2, F.array("o_orderstatus"))).alias("home"),
        titles.employment_type(joined("岗位性质：", pick(3, "全职", "兼职", "其他"))).alias("employment"),
        titles.stored_stage(joined("公告", pick(5, "延期", "补录", "", "", "")), F.lit(""), day, pick(11, "withdrawn", "unconfirmed", *["active"] * 9), none, "1998-06-01").alias("stage"),
        titles.change_alert(F.lit("extended"), joined("延至", day, "；其他"), k % 2 == 0).alias("alert"),
        talks.date_label(day, F.lit("9:30"), F.lit("11:00")).alias("label"),
        facts.deadline_change_kind(change, F.lit(""), moved, day).alias("moved"),
        facts.rolling_deadline(day, moved).alias("rolls"),
        F.array_join(titles.job_types(F.array().cast("array<string>"), F.when(k % 2 == 0, "具体岗位").otherwise("公告"), F.when(k % 3 == 0, "s-jobs").otherwise("s")), "|").alias("types"),
        collection.normal_salary(((k % 9 + 1) * 12_000).cast("double"), F.when(k % 9 >= 4, joined(((k % 9 + 1) * 12 / 10).cast("string"), "万")).otherwise("x")).alias("pay"),
        facts.education_matches(pick(4, "2026届 本科及以上", "本科", "硕士", "不限"), "本科", False).alias("for_bachelor"),
        facts.education_matches(pick(4, "本科及以上", "本科", "硕士", "不限"), "硕士", False).alias("for_master"),
    )


@query(
    """SELECT p_partkey, sha256('公告' || p_partkey || chr(10) || p_name || ' & ' || p_brand || chr(10) || '请各位考生认真阅读本公告并按时提交报名材料逾期不再受理感谢配合支持与理解祝考试顺利' || chr(10) || '单位名称 岗位名称 招聘人数' || chr(10) || p_brand || ' ' || p_name || '岗 ' || p_size || chr(10) || p_type || '岗 ' || p_size || chr(10) || '岗位表' || p_partkey) AS body_sha256,
              concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN '岗位表' || p_partkey || '=https://a.gov.cn/n/f' || p_partkey || '.xlsx' ELSE '岗位表' || p_partkey || '=https://b.cn/' || p_partkey || '?附件' END) AS attachments,
              p_brand || ':' || p_name || '岗:' || p_size || '|' || p_brand || ':' || p_type || '岗:' || p_size AS positions
       FROM part"""
)
def detail_pages(spark, sf_dir):
    """A page of each part: text of its container, a wrapped or plain attachment, a table with a row span, chrome around it."""
    k = F.col("p_partkey").cast("string")
    wrapped = F.concat(F.lit("https://school.gxjy.sdei.edu.cn/externalLink?target=h."), F.translate(F.base64(F.concat(F.lit('{"url":"https://b.cn/'), k, F.lit('?附件"}')).cast("binary")), "+/=", "-_"), F.lit(".s"))
    link = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("../n/f"), k, F.lit(".xlsx"))).otherwise(wrapped)
    html = F.concat(
        F.lit("<html><head><style>p{}</style><title>x</title></head><body><a href='/logo.png'>附件</a><div class='nav article2'>导航</div><div class='main content'><h1>公告"), k, F.lit("</h1><p>"), F.replace("p_name", F.lit(" "), F.lit("&nbsp;\n")), F.lit(" &amp; "), "p_brand",
        F.lit("<script>var a='<p>';</script></p><p>请各位考生认真阅读本公告并按时提交报名材料逾期不再受理感谢配合支持与理解祝考试顺利<table><tr><th>单位名称 <th>岗位名称 <th>招聘人数</tr><tr><td rowspan=2>"), "p_brand", F.lit(" <td>"), "p_name", F.lit("岗 <td>"), F.col("p_size").cast("string"),
        F.lit("</tr><tr><td>"), "p_type", F.lit("岗 <td>"), F.col("p_size").cast("string"), F.lit("</tr></table><a href='"), link, F.lit("'>岗位表"), k, F.lit("</a><a href='"), link, F.lit("'></a><a href='javascript:1'></a><a href='/img/x.gif'></a></div><div>页脚</div></body></html>"),
    )
    read = relational.dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_name", pages.detail_page(html, F.lit("https://a.gov.cn/x/y.html")).alias("p"))
    grids = read.select("p_partkey", "p_name", "p.body", "p.attachments", F.get("p.grids", F.lit(0)).alias("grid")).withColumn("exam_id", k)
    found = examtables.exam_positions(grids, merges=None)
    named = F.concat_ws(":", "employer", "position_name", F.col("recruit_count").cast("string"))
    return found.groupBy("p_partkey").agg(
        F.sha2(F.first("body"), 256).alias("body_sha256"), F.array_join(F.transform(F.first("attachments"), lambda a: F.concat_ws("=", a["title"], a["url"])), "|").alias("attachments"),
        # Two rows a page: the span's first row, then its second, whatever order they arrive in.
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((~F.startswith("position_name", F.col("p_name"))).alias("later"), named.alias("n")))), lambda x: x["n"]), "|").alias("positions"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 3 OR (c_nationkey % 4 < 2 AND c_custkey % 5 <> 4 AND c_custkey % 3 <> 0) THEN CASE WHEN c_nationkey % 4 = 3 THEN NULL ELSE '甲市' END
                                  WHEN c_nationkey % 4 < 2 AND c_custkey % 5 <> 4 THEN NULL WHEN c_custkey % 5 <> 4 AND c_custkey % 3 = 0 THEN '乙市' END AS city,
              CASE WHEN c_nationkey % 4 = 3 THEN 'online' WHEN c_nationkey % 4 < 2 AND c_custkey % 5 <> 4 AND c_custkey % 3 = 0 THEN 'conflicting_locations' WHEN c_custkey % 5 <> 4 AND c_custkey % 3 = 0 THEN 'explicit' WHEN c_nationkey % 4 < 2 AND c_custkey % 5 <> 4 THEN 'campus' ELSE 'unverified_venue' END AS method
       FROM customer"""
)
def event_places(spark, sf_dir):
    """Places of events at customers: named, of a campus rule, both in contradiction, online, or none."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    venue = F.concat(F.when(n % 4 == 3, "线上").when(n % 4 < 2, "东校区").otherwise("礼堂"), F.when((k % 5 != 4) & (k % 3 == 0), "（乙市）").otherwise(""), "c_name")
    events = relational.dealt(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.when(k % 5 == 4, "别校").otherwise("甲校").alias("school"), F.when(k % 5 == 4, F.regexp_replace(venue, "东校区", "西馆")).otherwise(venue).alias("venue"))
    rules = spark.createDataFrame([(1, "甲校", "东校区", "甲市"), (2, "丙校", "东", "丙市")], "rule_id int, rule_school string, pattern string, city string")
    return places.resolved_events(events, rules, "c_custkey", "school", "venue", {"甲市": ["甲市"], "乙市": ["乙市"], "丙市": ["丙市"]}).select("c_custkey", "city", "method")


@query(
    """SELECT count(*) AS exams, count(*) FILTER (o_orderkey % 3 > 0) AS with_positions, CAST(sum(o_orderkey % 3) AS BIGINT) AS positions, CAST(sum(o_custkey) AS BIGINT) AS headcount, '1|2|3' AS cities FROM orders"""
)
def exam_totals(spark, sf_dir):
    """Totals over orders as examinations with none to two positions."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 3 > 0, F.array_repeat(F.lit("p"), (k % 3).cast("int"))).alias("positions"), F.col("o_custkey").alias("headcount"), F.array((k % 3 + 1).cast("string")).alias("cities"))
    return publish.exam_totals(rows, "positions", "headcount", "cities").withColumn("cities", F.array_join("cities", "|"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN ts > TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-15' + INTERVAL 5 MINUTE THEN value END AS score,
              row_number() OVER (ORDER BY coalesce(CASE WHEN event_type = 'error' THEN NULL WHEN ts > TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-15' + INTERVAL 5 MINUTE THEN value END, -1) DESC, event_id) AS place FROM events"""
)
def fresh_scores(spark, sf_dir):
    """Scores of sources read in time, the best first and unrated ones last in the order there was; ranks come from a range partitioning."""
    at_now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    kept = collection.capped_scores(rows, "ts", at_now).withColumn("_score", F.coalesce("score", F.lit(-1.0)))
    return relational.ranked(kept, [(F.col("_score"), "desc"), F.col("event_id")], "place").select("event_id", "score", "place")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) THEN 'ignored' WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 1 THEN 'ignored' WHEN o_orderkey % 7 = 0 THEN 'kept' ELSE 'pending' END AS decision FROM orders"""
)
def calendar_decisions(spark, sf_dir):
    """H6: what a list does to records of orders: nothing new beside a verified detail, a kept detail, or a pending one; a vanished event counts when its title says it was called off."""
    k = F.col("o_orderkey")
    event = lambda day: F.struct(day.alias("date"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    new = F.when(k % 5 != 0, event(day))
    old = F.when(k % 3 == 1, event(day)).otherwise(event(F.lit("1990-01-01")))
    title = F.when((k % 2 == 0) & (k % 3 == 0) & (k % 5 == 0), "取消宣讲：甲").otherwise("甲")
    return table(spark, sf_dir, "orders").select("o_orderkey", talks.calendar_verification(new, old, F.lit("甲"), title, k % 7 == 0).alias("decision"))
