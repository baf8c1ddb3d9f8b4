"""What is known of an examination from its text, its position rows and its attachments together.

All three become rows of one shape: a rank of evidence, counts and numbers. They meet in a single aggregate by examination of
maxima and sums, which combines before the shuffle, so an examination with a third of all positions is no hot key. The status is
a maximum in a lattice: none, attachments that speak of positions, positions in prose, positions of a table. What the text
says by itself is an expression in its row and travels as a struct.

Null texts count as empty; position and attachment rows without a notice are left out; a repeated notice counts once, by its
greatest text. Examinations without rows or attachments keep what their text says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spaced

STATUS = ("none", "attachment_only", "prose", "parsed")
# Patterns of head and position counts with their bounds, and of attachments that list positions.
HEADS_TITLE = r"(?:^|[·\s（(【]|共)\s*(\d{1,4})\s*[名人](?:[！!）)】\s]|$)"
HEADS_TEXT = r"(?:公开招聘|计划招聘|拟招聘|拟公开招聘|共招聘|招录|招考|招募|引进)[^。\n；;]{0,28}?(\d{1,4})\s*[名人]"
POSTS_TEXT, MOST_HEADS, MOST_POSTS, MOST_ROW = r"(\d{1,4})\s*个(?:招聘)?(?:岗位|职位)", 50_000, 20_000, 5_000
LISTS_POSTS = "岗位|职位|计划|汇总表|一览表"
# Conditions as (name, pattern, what is shown) with groups, and the first of several that holds.
RATIO, AGE, SERVICE = r"开考比例[^。\n]{0,15}?(1\s*[：:]\s*\d+)", r"年龄(?:在|一般为|不超过)?\s*(\d{2})\s*周岁(?:及)?以下", r"最低服务年限(?:为)?\s*(\d+|一|二|三|五)\s*年"
HUKOU = (("限.*户籍|具有.*常住户口|生源地.*限", "部分岗位限本地户籍/生源"), ("不限户籍|户籍不限", "不限户籍"))
FRESH = (("专项招聘.*高校毕业生|仅限.*应届|面向202\\d届|202\\d届.*公费师范", "主要面向应届高校毕业生（含择业期）"),)
CIVIL, FRESH_CIVIL, PARTY, PARTY_SHOWN = "选调", "限应届优秀高校毕业生", "均须为中共党员|必须为中共党员", "要求中共党员（含预备党员）或主要学生干部"
DOCTOR_TITLE, DOCTOR, NOT_DOCTOR = "博士|高层次|高级人才", "博士研究生|博士学位|招聘博士", "本科|硕士"
MASTER, NOT_MASTER = "硕士研究生及以上|硕士及以上|硕士学位", "本科及以上|大学本科"
LEVELS = (("本科及以上|大学本科及以上|全日制本科|本科以上学历", "本科及以上"), ("专科及以上|大专及以上|高中|中专", "专科及以上"))
UNLIMITED, UNLIMITED_ROW = "专业不限|不限专业", "不限"


def _first(text: Column, rules: tuple[tuple[str, str], ...], before: Column | None = None) -> Column:
    start = before if before is not None else F.when(F.lit(False), "")
    return reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), rules, start).otherwise("")


def text_facts(title: Column, body: Column) -> Column:
    """What a notice says by itself: conditions, and its greatest numbers of people and positions within bounds."""
    head, text = F.coalesce(title, F.lit("")), F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    given = lambda p, f: F.when(text.rlike(spaced(p)), f(F.regexp_extract(text, spaced(p), 1)))

    def greatest(source: Column, pattern: str, most: int) -> Column:
        numbers = F.transform(F.regexp_extract_all(source, F.lit(spaced(pattern)), F.lit(1)), lambda n: n.cast("int"))
        return F.coalesce(F.array_max(F.filter(numbers, lambda n: n <= most)), F.lit(0))

    shown = lambda a, b: lambda c: F.concat(F.lit(a), c, F.lit(b))
    heads = F.greatest(greatest(F.regexp_extract(head, spaced(HEADS_TITLE), 0), r"(\d{1,4})", MOST_HEADS), greatest(text, HEADS_TEXT, MOST_HEADS))
    level = F.when(head.rlike(DOCTOR_TITLE) | (text.rlike(DOCTOR) & ~text.rlike(NOT_DOCTOR)), "博士研究生").when(text.rlike(MASTER) & ~text.rlike(NOT_MASTER), "硕士研究生及以上")
    return F.struct(
        given(RATIO, lambda c: F.replace(F.regexp_replace(c, spaced(r"\s+"), ""), F.lit("："), F.lit(":"))).alias("exam_ratio"),
        given(AGE, shown("", "周岁及以下")).alias("age_limit"),
        given(SERVICE, shown("最低服务年限", "年")).alias("service_years"),
        _first(text, HUKOU).alias("hukou"),
        reduce(lambda c, r: c.when(text.rlike(r[0]), r[1]), FRESH, F.when(F.lit(False), "")).when(head.rlike(CIVIL), FRESH_CIVIL).otherwise("").alias("fresh_grads"),
        F.when(head.rlike(CIVIL) | text.rlike(PARTY), PARTY_SHOWN).otherwise("").alias("party"),
        _first(text, LEVELS, level).alias("education"),
        text.rlike(UNLIMITED).alias("unlimited"),
        heads.alias("heads"),
        greatest(text, POSTS_TEXT, MOST_POSTS).alias("posts"),
    )


def enriched_exams(exams: DataFrame, positions: DataFrame, attachments: DataFrame, key: str = "exam_id") -> DataFrame:
    """One row per examination: ``positions_status``, ``total_positions``, ``total_headcount``, ``unlimited`` and the conditions of its text.

    ``exams``: key, title, body; ``positions``: key, recruit_count, major_raw, source (prose or else); ``attachments``: key, title.
    """
    numbers = ("rank", "rows", "heads", "text_heads", "text_posts")
    facts = text_facts(F.col("title"), F.col("body"))
    zero = {n: F.lit(0).cast("long") for n in numbers}

    def evidence(df: DataFrame, said: Column, unlimited: Column, **own: Column) -> DataFrame:
        return df.select(F.col(key), *[own.get(n, zero[n]).cast("long").alias(n) for n in numbers], unlimited.alias("unlimited"), said.alias("said"))

    texts = exams.select(key, facts.alias("f"))
    kind = texts.schema["f"].dataType
    count = F.when(F.col("recruit_count").between(1, MOST_ROW), F.col("recruit_count"))
    rows = (
        evidence(texts, F.col("f"), F.col("f.unlimited"), text_heads=F.col("f.heads"), text_posts=F.col("f.posts"))
        .unionByName(evidence(positions, F.lit(None).cast(kind), F.contains(F.coalesce("major_raw", F.lit("")), F.lit(UNLIMITED_ROW)), rank=F.when(F.col("source") == "prose", 2).otherwise(3), rows=F.lit(1), heads=F.coalesce(count, F.lit(0))))
        .unionByName(evidence(attachments, F.lit(None).cast(kind), F.lit(False), rank=F.coalesce(F.col("title"), F.lit("")).rlike(LISTS_POSTS).cast("int")))
    )
    met = rows.groupBy(key).agg(
        F.max("rank").alias("rank"), F.sum("rows").alias("rows"), F.sum("heads").alias("heads"), F.max("text_heads").alias("text_heads"), F.max("text_posts").alias("text_posts"), F.bool_or("unlimited").alias("unlimited"), F.max("said").alias("said")
    )
    total = lambda a, b: F.nullif(F.greatest(a, b), F.lit(0))
    conditions = [f for f in kind.names if f not in ("unlimited", "heads", "posts")]
    return met.where("said IS NOT NULL").select(
        key, F.element_at(F.array(*map(F.lit, STATUS)), (F.col("rank") + 1).cast("int")).alias("positions_status"), total("rows", "text_posts").alias("total_positions"), total("heads", "text_heads").alias("total_headcount"), "unlimited", *[f"said.{f}" for f in conditions]
    )
