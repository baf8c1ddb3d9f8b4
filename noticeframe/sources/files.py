"""Tables inside HTML, XLSX, DOCX and ZIP files, and the positions in them.

Files are read with Spark's ``binaryFile`` source and parsed per file in Arrow-batched tasks, a few at a time, so memory does
not follow the number of files; only standard-library parsers are used. PDF and XLS need libraries that are not there: they give one row
with status ``unsupported``, as any file that cannot be read gives one with its error.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import slices
from ..operators.extract import positions_of_grid, text_grid

ROW_SPAN, COLUMN_SPAN = 50, 20
MEMBERS, MEMBER_BYTES = 30, 25 * 1024 * 1024
#: Files and tables that are Python objects at once; what comes out of them goes on before the next are read.
FILES = 32
POSITION_FIELDS = ("name", "category", "majors", "education", "count", "city", "cohort", "notes")

Grid = list[list[str]]


class Tables(HTMLParser):
    """Grids of all tables, inner tables before outer ones, spans expanded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list[list[str] | None] = []
        self.spans: list[tuple[int, int]] = []
        self.grids: list[Grid] = []

    def _close_cell(self) -> None:
        if self.open and self.cell[-1] is not None:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append((" ".join("".join(self.cell[-1]).split()), *self.spans[-1]))
            self.cell[-1] = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append([])
            self.cell.append(None)
            self.spans.append((1, 1))
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            given = dict(attrs)
            number = lambda k, most: min(most, max(1, int(m[0]))) if (m := re.search(r"\d+", given.get(k) or "")) else 1
            self.cell[-1], self.spans[-1] = [], (number("rowspan", ROW_SPAN), number("colspan", COLUMN_SPAN))
        elif self.open and tag in ("br", "p", "div") and self.cell[-1]:
            self.cell[-1].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.open and tag == "table":
            self._close_cell()
            rows = self.open.pop()
            self.cell.pop()
            self.spans.pop()
            self.grids.append(expand(rows))

    def filled(self) -> list[Grid]:
        """Grids with any text."""
        return [g for g in self.grids if any(any(r) for r in g)]

    def handle_data(self, data: str) -> None:
        if self.open and self.cell[-1] is not None:
            self.cell[-1].append(data)


def expand(rows: list[list[tuple[str, int, int]]]) -> Grid:
    """Cells with (text, rowspan, colspan) as a full grid; a spanned place repeats the text."""
    held: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in held:
                c += 1
            for dr in range(min(down, len(rows) - r)):
                for dc in range(across):
                    held.setdefault((r + dr, c + dc), text)
            c += across
    width = max((c for _, c in held), default=-1) + 1
    return [[held.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def html_grids(html: str) -> list[Grid]:
    parser = Tables()
    parser.feed(html or "")
    parser.close()
    return parser.filled()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xlsx_grids(data: bytes) -> list[Grid]:
    """All sheets; shared and inline strings; merged ranges repeat their first cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        grids = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            root, cells, merges = ElementTree.fromstring(z.read(name)), {}, []
            for e in root.iter():
                if _local(e.tag) == "mergeCell":
                    merges.append(e.attrib["ref"])
                elif _local(e.tag) == "c":
                    kind, ref = e.attrib.get("t"), e.attrib.get("r", "")
                    value = next((v.text or "" for v in e if _local(v.tag) == "v"), "")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
                    elif re.fullmatch(r"-?\d+\.0+", value):
                        value = value.partition(".")[0]
                    cells[_place(ref)] = value.strip()
            for ref in merges:
                (r0, c0), (r1, c1) = (_place(p) for p in (ref.split(":") * 2)[:2])
                for r in range(r0, min(r1, r0 + ROW_SPAN) + 1):
                    for c in range(c0, min(c1, c0 + COLUMN_SPAN) + 1):
                        cells[r, c] = cells.get((r0, c0), "")
            if cells:
                height, width = (max(k[i] for k in cells) + 1 for i in (0, 1))
                grids.append([[cells.get((r, c), "") for c in range(width)] for r in range(height)])
        return grids


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(digits) - 1, column - 1


def docx_grids(data: bytes) -> list[Grid]:
    """All tables of a document; vertical merges repeat the text above, grid spans repeat the cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    grids = []
    for table in (e for e in root.iter() if _local(e.tag) == "tbl"):
        grid: Grid = []
        for row in (e for e in table if _local(e.tag) == "tr"):
            out: list[str] = []
            for cell in (e for e in row if _local(e.tag) == "tc"):
                value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t").strip()
                across, follows = 1, False
                for p in (x for e in cell if _local(e.tag) == "tcPr" for x in e):
                    attrs = {_local(k): v for k, v in p.attrib.items()}
                    if _local(p.tag) == "gridSpan":
                        across = min(COLUMN_SPAN, int(attrs.get("val", 1)))
                    elif _local(p.tag) == "vMerge":
                        follows = attrs.get("val", "continue") == "continue"
                if follows and grid and len(grid[-1]) > len(out):
                    value = grid[-1][len(out)]
                out += [value] * across
            grid.append(out)
        if any(any(r) for r in grid):
            grids.append(grid)
    return grids


def kind_of(path: str, head: bytes) -> str:
    """By signature first, then by extension."""
    end = path.lower().rpartition(".")[2]
    if head[:4] == b"PK\x03\x04":
        return end if end in ("xlsx", "docx") else "zip"
    if head[:4] == b"%PDF":
        return "pdf"
    if head[:4] == b"\xd0\xcf\x11\xe0":
        return "xls" if end != "doc" else "doc"
    if head.lstrip()[:1] == b"<":
        return "html"
    return "text"


def member_name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag are GBK."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for code in ("utf-8", "gbk"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return info.filename


def grids_of(path: str, data: bytes, nested: bool = False) -> Iterator[tuple[str, str, Grid | None]]:
    """``(member path, status, grid)`` per table of a file."""
    kind = kind_of(path, data[:8])
    try:
        if kind == "zip":
            if nested:
                yield path, "nested archive", None
                return
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                members = [i for i in z.infolist() if not i.is_dir()]
                for info in members[:MEMBERS]:
                    name = f"{path}!{member_name(info)}"
                    if info.file_size > MEMBER_BYTES:
                        yield name, "too large", None
                    else:
                        yield from grids_of(name, z.read(info), True)
                for info in members[MEMBERS:]:
                    yield f"{path}!{member_name(info)}", "too many members", None
            return
        readers = {"xlsx": xlsx_grids, "docx": docx_grids, "html": lambda d: html_grids(d.decode("utf-8", "replace")), "text": lambda d: [text_grid(d.decode("utf-8", "replace"))]}
        if kind not in readers:
            yield path, "unsupported", None
            return
        for grid in readers[kind](data):
            if grid:
                yield path, "ok", grid
    except Exception as e:  # a broken file is a fact about the file, not a failure of the job
        yield path, f"unreadable: {type(e).__name__}", None


TABLE_SCHEMA = "path string, status string, table_no int, grid array<array<string>>"


def file_tables(files: DataFrame) -> DataFrame:
    """Tables of binary files (columns path, content): one row each, or one row with the reason."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in (p for batch in batches for p in slices(batch, FILES)):
            rows = []
            for path, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += [(p, status, n, grid) for n, (p, status, grid) in enumerate(grids_of(path, data or b""))]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=["path", "status", "table_no", "grid"])

    return files.select("path", "content").mapInArrow(run, TABLE_SCHEMA)


def read_files(spark, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def table_positions(tables: DataFrame) -> DataFrame:
    """Positions in grids: one row per position with the grid's path and number."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in (p for batch in batches for p in slices(batch, FILES)):
            rows = []
            for path, number, grid in zip(*(part.column(i).to_pylist() for i in range(3))):
                rows += [(path, number, *[p.get(f) for f in POSITION_FIELDS]) for p in positions_of_grid(grid or [])]
            columns = list(zip(*rows)) or [()] * (2 + len(POSITION_FIELDS))
            kinds = [pa.string(), pa.int32(), *[pa.string()] * len(POSITION_FIELDS)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=["path", "table_no", *POSITION_FIELDS])

    fields = ", ".join(f"`{f}` string" for f in POSITION_FIELDS)
    return tables.select("path", "table_no", "grid").mapInArrow(run, f"path string, table_no int, {fields}")


class _Links(HTMLParser):
    """Links with their text, and the first date near each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.inside = bool(href)
            if href:
                self.links.append([href, "", ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if not self.links:
            return
        if self.inside:
            self.links[-1][1] += data
        if not self.links[-1][2] and (m := re.search(r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})", data)):
            self.links[-1][2] = f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"


def list_items(pages: DataFrame, url: str, html: str, include: str = ".", exclude: str = "(?!)") -> DataFrame:
    """``(page, link, title, published_at)`` of list pages, filtered by title patterns."""

    def run(batches: Iterator) -> Iterator:
        from urllib.parse import urljoin

        import pyarrow as pa

        for part in (p for batch in batches for p in slices(batch)):
            rows = []
            for page, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                parser = _Links()
                parser.feed(body or "")
                for href, title, day in parser.links:
                    title = " ".join(title.split())
                    if title and re.search(include, title) and not re.search(exclude, title):
                        rows.append((page, urljoin(page or "", href), title, day or None))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.string()) for c in columns], names=["page", "link", "title", "published_at"])

    return pages.select(F.col(url).alias("page"), F.col(html).alias("body")).mapInArrow(run, "page string, link string, title string, published_at string")


def embedded_state(html: Column, schema: str, name: str = "__INITIAL_STATE__") -> Column:
    """JSON assigned to ``window.<name>`` in a page, by schema."""
    return F.from_json(F.regexp_extract(html, rf"window\.{name}\s*=\s*(\{{.*?\}})\s*(?:;|</script>)", 1), schema)
