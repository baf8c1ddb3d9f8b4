"""Queries of sources and sinks: rows of the tables are written in each format and read back through the operator.

The SQL of each is the rows themselves, so a query is green when nothing is lost, added or changed on the way.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from .batches import mapped
from .catalog import query, table
from .durability import shared_folder
from .operators import calendar, publish, relational
from .sources import files, snapshots


def folder(spark) -> str:
    """A new folder that every machine sees."""
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def snapshot_round_trip(spark, sf_dir):
    """A snapshot is written with its manifest, verified, checked for unique keys and read back."""
    at, rows = folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    manifest = snapshots.write_snapshot(rows, at, "o_orderkey", 1)
    total = manifest.agg(F.sum("rows")).first()[0]
    if not snapshots.verify_snapshot(spark, at).isEmpty():
        raise ValueError("the snapshot differs from its manifest")
    return snapshots.guarded(spark.read.parquet(f"{at}/rows").drop("prefix"), "o_orderkey", total)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def snapshot_one_key(spark, sf_dir):
    """One key from one partition; one key is the feature."""
    at = folder(spark)
    snapshots.write_snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), at, "o_orderkey", 1)
    return snapshots.read_one(spark, at, "o_orderkey", 77, 1).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def shard_scan(spark, sf_dir):
    """Shards of JSON under a given schema, unique keys checked."""
    at = folder(spark)
    row = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    shards = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("shard")).agg(F.collect_list(row).alias("jobs"))
    shards.select(F.to_json(F.struct("jobs")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return snapshots.guarded(snapshots.read_shards(spark, [at], "struct<id:bigint,name:string,segment:string>"), "id")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS balance FROM supplier")
def hydrated_rows(spark, sf_dir):
    """Null fields filled from a detail table."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") * 2).alias("balance"))
    return snapshots.hydrated(rows, s.select("s_suppkey", F.col("s_acctbal").alias("balance")), "s_suppkey", ["balance"])


@query("SELECT n_name AS title, 'https://h.cn/' || n_nationkey AS url, CAST(NULL AS VARCHAR) AS school, CAST(n_regionkey AS VARCHAR) AS fair_date FROM nation UNION ALL SELECT r_name, CAST(NULL AS VARCHAR), 'school ' || r_regionkey, CAST(NULL AS VARCHAR) FROM region")
def calendar_union(spark, sf_dir):
    """JSON answers of two formats as one event table; what a format lacks is null."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("t"), F.concat(F.lit("https://h.cn/"), F.col("n_nationkey").cast("string")).alias("u"), F.col("n_regionkey").alias("d"))).alias("list"))
    r = table(spark, sf_dir, "region").agg(F.collect_list(F.struct(F.col("r_name").alias("name"), F.concat(F.lit("school "), F.col("r_regionkey").cast("string")).alias("place"))).alias("rows"))
    one = (n.select(F.to_json(F.struct(F.struct("list").alias("data"))).alias("body")), "body", "data struct<list:array<struct<t:string,u:string,d:int>>>", "data.list", {"title": F.col("r.t"), "url": F.col("r.u"), "fair_date": F.col("r.d")})
    two = (r.select(F.to_json(F.struct("rows")).alias("body")), "body", "rows array<struct<name:string,place:string>>", "rows", {"title": F.col("r.name"), "school": F.col("r.place")})
    return snapshots.calendar_events([one, two]).select("title", "url", "school", "fair_date")


def _bytes_of(make):
    """Files of lists of (name, size) made by ``make``."""

    @F.arrow_udf("binary")
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield mapped(rows, lambda r: make([(x["n"], x["s"]) for x in r]), pa.binary())

    return build


def _html(rows) -> bytes:
    return ("<html><table><tr><th>岗位名称</th><th>招聘人数</th></tr>" + "".join(f"<tr><td>{n}</td><td> {s} </td></tr>" for n, s in rows) + "</table></html>").encode()


def _text(rows) -> bytes:
    return ("岗位名称|招聘人数\n---|---\n" + "\n".join(f"{n} | {s}" for n, s in rows)).encode()


def _packed(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _xlsx(rows) -> bytes:
    cell = lambda at, v: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [("岗位名称", "招聘人数"), *rows]
    sheet = "".join(f'<row r="{i}">{cell(f"A{i}", n)}{cell(f"B{i}", s)}</row>' for i, (n, s) in enumerate(lines, 1))
    return _packed({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="x"><sheetData>{sheet}</sheetData></worksheet>'.encode()})


def _docx(rows) -> bytes:
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{v}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:tr>{cell(n)}{cell(s)}</w:tr>" for n, s in [("岗位名称", "招聘人数"), *rows])
    return _packed({"word/document.xml": f'<w:document xmlns:w="w"><w:tbl>{body}</w:tbl></w:document>'.encode()})


def _zip(rows) -> bytes:
    half = len(rows) // 2
    return _packed({"one.xlsx": _xlsx(rows[:half]), "two/three.html": _html(rows[half:])} if half else {"all.html": _html(rows)})


def _positions(spark, sf_dir, make, end: str):
    """Parts as positions in files of fifty, read as tables, then as positions."""
    parts = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("n"), F.col("p_size").cast("string").alias("s"), F.floor(F.col("p_partkey") / 50).cast("string").alias("f"))
    grouped = relational.dealt(parts, "f").groupBy("f").agg(F.collect_list(F.struct("n", "s")).alias("rows"))
    made = grouped.select(F.concat("f", F.lit(end)).alias("path"), _bytes_of(make)("rows").alias("content"))
    return files.table_positions(files.file_tables(made).where("status = 'ok'")).select("name", F.col("count").cast("int").alias("headcount"))


PARTS_SQL = "SELECT p_name || ' ' || p_partkey AS name, p_size AS headcount FROM part"


@query(PARTS_SQL)
def html_positions(spark, sf_dir):
    """Position tables in pages."""
    return _positions(spark, sf_dir, _html, ".html")


@query(PARTS_SQL)
def xlsx_positions(spark, sf_dir):
    """Position tables in workbooks."""
    return _positions(spark, sf_dir, _xlsx, ".xlsx")


@query(PARTS_SQL)
def docx_positions(spark, sf_dir):
    """Position tables in documents."""
    return _positions(spark, sf_dir, _docx, ".docx")


@query(PARTS_SQL)
def zip_positions(spark, sf_dir):
    """Position tables in archives of workbooks and pages."""
    return _positions(spark, sf_dir, _zip, ".zip")


@query(PARTS_SQL)
def text_positions(spark, sf_dir):
    """Position tables in plain text."""
    return _positions(spark, sf_dir, _text, ".txt")


@query("SELECT 'https://h.cn/' || (s_suppkey // 20) || '/list/' AS page, 'https://h.cn/item/' || s_suppkey || '.html' AS link, s_name || ' 招聘' AS title, '2026-03-' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS published_at FROM supplier WHERE s_suppkey % 7 <> 0")
def list_pages(spark, sf_dir):
    """Links, titles and days of list pages; some titles are filtered out."""
    k = F.col("s_suppkey")
    item = F.concat(F.lit('<li><a href="/item/'), k.cast("string"), F.lit('.html">'), "s_name", F.when(k % 7 == 0, " 新闻").otherwise("  招聘"), F.lit("</a> <i>2026年3月"), (F.col("s_nationkey") + 1).cast("string"), F.lit("日</i></li>"))
    pages = table(spark, sf_dir, "supplier").groupBy(F.floor(k / 20).alias("p")).agg(F.array_join(F.collect_list(item), "").alias("html"))
    return files.list_items(pages.select(F.concat(F.lit("https://h.cn/"), F.col("p").cast("string"), F.lit("/list/")).alias("url"), "html"), "url", "html", include="招聘")


@query("SELECT c_custkey, c_name AS name, c_nationkey AS place FROM customer")
def embedded_pages(spark, sf_dir):
    """JSON that a page assigns to a variable."""
    state = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("place")).alias("deep")))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("<script>var a = {}; window.__INITIAL_STATE__ = "), state, F.lit(" ;</script>")).alias("html"))
    return pages.select("c_custkey", files.embedded_state(F.col("html"), "name string, deep struct<place:int>").alias("s")).select("c_custkey", "s.name", F.col("s.deep.place").alias("place"))


@query(
    """WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT '<rss version="2.0"><channel><title>c</title>' || string_agg('<item><title>a &amp; ' || o_orderkey || '</title><link>https://h.cn/?a=1&amp;b=' || o_orderkey || '</link><guid>' || o_orderkey || '</guid></item>', '' ORDER BY n) || '</channel></rss>' AS rss FROM t WHERE n <= 60"""
)
def rss_feed(spark, sf_dir):
    """K6: the first sixty rows as a feed; the limit is the feature."""
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("a & "), k).alias("title"), F.concat(F.lit("https://h.cn/?a=1&b="), k).alias("link"))
    return calendar.rss_feed(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "title", "link", "o_orderkey", "c")


@query(
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR)) AS n FROM orders)
SELECT 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || o_orderkey, 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d'), 'SUMMARY:order\\, ' || o_orderkey, 'DESCRIPTION:x\\;y', 'END:VEVENT'), chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10) || 'END:VCALENDAR' || chr(13) || chr(10) AS ics FROM t WHERE n <= 250"""
)
def ics_feed(spark, sf_dir):
    """K7: the next 250 events as a calendar; the limit is the feature."""
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(k.alias("uid"), F.concat(F.lit("order, "), k).alias("summary"), F.col("o_orderdate").cast("date").alias("day"), F.lit("x;y").alias("detail"))
    return calendar.ics_feed(rows, "uid", "summary", "day", "detail")


@query("SELECT o_orderkey, 'NATION' || CASE WHEN o_orderkey % 3 = 0 THEN '全国' ELSE '' END AS title, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS nationwide, CASE WHEN o_orderkey % 5 = 0 THEN repeat('好', 89) || '…' ELSE '短' END AS excerpt, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS n_cities, lower('NATION' || CASE WHEN o_orderkey % 3 = 0 THEN '全国' ELSE '' END || ' Co') || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN repeat('好', 89) || '…' ELSE '短' END AS search_text FROM orders")
def browse_rows(spark, sf_dir):
    """What a browsing list holds of each row."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("NATION"), F.when(k % 3 == 0, "全国").otherwise("")).alias("title"), F.lit("Co").alias("company"), F.when(k % 2 == 1, F.array(F.lit("x"))).alias("cities"), F.when(k % 5 == 0, "好" * 120).otherwise("短").alias("excerpt"))
    return publish.browsing(rows).select("o_orderkey", "title", "nationwide", "excerpt", F.size("cities").alias("n_cities"), "search_text")


@query(
    """SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list_distinct(list('f' || l_returnflag))), '|') AS samples, array_to_string(list_sort(list_distinct(list('m' || (l_linenumber % 3)))), '|') AS majors,
  array_to_string(list_sort(list_distinct(list(l_linestatus))), '|') AS cities FROM lineitem GROUP BY 1"""
)
def position_summary(spark, sf_dir):
    """Count, names, majors and cities of nested positions; shown sorted."""
    row = F.struct(F.concat(F.lit("f"), "l_returnflag").alias("name"), F.array(F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string"))).alias("majors"), F.col("l_linestatus").alias("city"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("positions"))
    f = nested.select("l_orderkey", publish.position_facts(F.col("positions")).alias("f"))
    shown = lambda c: F.array_join(F.array_sort(F.col(f"f.{c}")), "|").alias(c)
    return f.select("l_orderkey", F.col("f.count").cast("long").alias("n"), shown("samples"), shown("majors"), shown("cities"))
