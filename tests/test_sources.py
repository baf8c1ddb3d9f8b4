"""Tables in files, list pages, snapshots."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from noticeframe.sources import files, snapshots

SHEET = """<worksheet xmlns="x"><sheetData><row><c r="A1" t="inlineStr"><is><t>岗位名称</t></is></c><c r="B1" t="s"><v>0</v></c></row>
<row><c r="A2" t="inlineStr"><is><t>工程师</t></is></c><c r="B2"><v>3.0</v></c></row></sheetData><mergeCells><mergeCell ref="B2:B3"/></mergeCells></worksheet>"""
SHARED = '<sst xmlns="x"><si><t>招聘人数</t></si></sst>'
DOC = '<w:document xmlns:w="w"><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>'


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_file_tables(spark):
    xlsx = packed({"xl/sharedStrings.xml": SHARED, "xl/worksheets/sheet1.xml": SHEET})
    rows = [("a.xlsx", xlsx), ("b.docx", packed({"word/document.xml": DOC})), ("c.zip", packed({"in.xlsx": xlsx, "deep.zip": packed({"x": "y"})})), ("d.pdf", b"%PDF-1.4"), ("e.xlsx", b"PK\x03\x04broken"), ("f.html", b"<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</table>"), ("g", b"")]
    got = files.file_tables(spark.createDataFrame(rows, "path string, content binary")).cache()
    by = {r.path: r for r in got.collect()}
    assert by["a.xlsx"].grid == [["岗位名称", "招聘人数"], ["工程师", "3"], ["", "3"]]
    assert by["b.docx"].grid == [["a", "b", "b"]]
    assert by["c.zip!in.xlsx"].grid[1] == ["工程师", "3"] and by["c.zip!deep.zip"].status == "nested archive"
    assert by["d.pdf"].status == "unsupported" and by["e.xlsx"].status.startswith("unreadable")
    assert by["f.html"].grid == [["a", "b"], ["a", "c"]]
    positions = files.table_positions(got.where("status = 'ok'")).where("path = 'a.xlsx'").collect()
    assert [(p.name, p["count"]) for p in positions] == [("工程师", "3")]


def test_list_items(spark):
    html = '<ul><li><a href="/1.html">招聘公告</a><span>2026-01-02</span></li><li><a href="/2.html">新闻</a></li></ul>'
    got = files.list_items(spark.createDataFrame([("http://h.cn/list/", html)], "url string, html string"), "url", "html", include="招聘").collect()
    assert [tuple(r) for r in got] == [("http://h.cn/list/", "http://h.cn/1.html", "招聘公告", "2026-01-02")]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), (F.col("id") * 2).alias("v"))
    folder = str(tmp_path / "snap")
    snapshots.write_snapshot(df, folder, "id")
    assert snapshots.verify_snapshot(spark, folder).isEmpty()
    assert [r.v for r in snapshots.read_one(spark, folder, "id", 7).collect()] == [14]


def test_shards_and_api(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"jobs": [{"id": "a", "n": 1}, {"id": "b", "n": None}]}))
    rows = snapshots.read_shards(spark, [str(path)], "struct<id:string,n:int>")
    assert snapshots.guarded(rows, "id", 2).count() == 2
    pages = spark.createDataFrame([('{"data":{"list":[{"t":"x","u":"/y"}]}}',)], "body string")
    got = snapshots.calendar_events([(pages, "body", "data struct<list:array<struct<t:string,u:string>>>", "data.list", {"title": F.col("r.t"), "url": F.col("r.u")})]).first()
    assert (got.title, got.url, got.school) == ("x", "/y", None)


def test_tables_go_on_a_few_files_at_a_time():
    """of a batch of any number of files, only a few are Python objects before their tables and positions go on."""
    import pyarrow as pa

    from noticeframe.batches import mapped
    from noticeframe.sources import files

    class Given:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    page = "<table><tr><th>岗位名称<th>招聘人数</tr>" + "".join(f"<tr><td>n{i}<td>{i}</tr>" for i in range(50)) + "</table>"
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.html" for i in range(500)], "content": [page.encode()] * 500})
    tables = list(files.file_tables(Given())(iter([batch])))
    assert sum(b.num_rows for b in tables) == 500 and max(b.num_rows for b in tables) <= 32
    grids = pa.Table.from_batches(tables).combine_chunks().select(["path", "table_no", "grid"]).to_batches()
    assert len(grids) == 1
    found = list(files.table_positions(Given())(iter(grids)))
    assert sum(b.num_rows for b in found) == 25_000 and max(b.num_rows for b in found) <= 32 * 50
    assert mapped(pa.array(range(1000)).slice(1), lambda x: x and str(x), pa.string()).to_pylist() == [str(i) for i in range(1, 1000)]
    assert mapped(pa.array([], pa.int64()), str, pa.string()).to_pylist() == []
