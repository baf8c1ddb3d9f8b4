"""Detail pages as text, tables and attachments.

A page is walked once as a stream of tags, which its tables come from too. Where its content stands is data: an ordered list of containers per source (an id, a
class or a tag), the first that occurs counts. Pages are read in Arrow batches, each by itself.

Null and empty pages have an empty body, no tables and no attachments. Unclosed and crossed tags are closed by what follows. A
container with hardly any text gives way to the whole page. Links that are no web addresses are left out; a repeated address counts once.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import parse_qs, unquote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..batches import mapped
from .files import Tables

# Containers in order, how much text one needs, what an attachment's address or title says, and what is shown without a title.
CONTAINERS = ("#zoom", ".TRS_Editor", ".x1_tit2", ".sub_x", ".wencon", ".article", ".content", "body")
LEAST_TEXT, MOST_TEXT, MOST_FILES, LONGEST_TITLE, NAMELESS = 40, 18_000, 15, 100, "官方附件"
FILE, FILE_TITLE = r"\.(xlsx?|xls|pdf|docx?|zip|rar)(?:\?|$)", "附件|岗位|职位|汇总表|需求表|计划表|报名表|一览表"
GOVERNMENT = r"https?://[a-z0-9.-]+\.gov\.cn(?::\d+)?"
# A portal that wraps addresses or takes other hosts' paths as its own, and where those belong.
PORTAL, WRAPPED, HOME = "sdei.edu.cn", "/externalLink", "hrss.shandong.gov.cn"
OWN_PATH, PREFIXED, GATEWAY = "/resource/srst/att/", r"^/[a-z]{2,12}(/n\d+/n\d+/c\d+/part/.+)$", "/api-gateway/jpaas-"
FOREIGN = r"^(?:/api-gateway/jpaas-|/module/download/downfile\.jsp|/n\d+/n\d+/c\d+/part/)"
# Addresses of icons, advertisements and other chrome.
JUNK = (
    r"bszs\.conac\.cn|zfwzgl\.www\.gov\.cn/exposure/jiucuo|rsks\.class\.com\.cn|(?:huatu|offcn|fenbi)\.com|AdminLogin\.aspx|BlankPage\.aspx|PharmacyWindow\.aspx|/Index\.aspx$|cpta\.com\.cn/(?:promise|testPlan|certQuery|syllabus)\.html|"
    r"fileTypeImages/icon_|/module/jslib/icons/|/channels/ch\d+/?$|/cms_files/filemanager/\d+/picture/|gov\.cn/zhuanti/|(?:/statics/images/|/img/|/picture/)(?:[^?#]*?)(?:\.png|\.jpg|\.jpeg|\.gif)$|"
    r"(?:wechat|wx|qrcode|flogo|logo|foot-tel|foot-address|foot-car|inside-location|inside-icon|nav(?:-img)?)\.(?:png|jpg|jpeg|gif|svg)$"
)
BARE_HOME, PICTURE = r"^https?://(?:(?:www|mohrss|scs)\.)?gov\.cn/?$", r"\.(?:gif|svg|ico)(?:\?|$)"
NO_TITLES, NO_PICTURE_TITLES = (NAMELESS, ""), ("招聘图片（文字未自动识别）", "查看链接", NAMELESS, "")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "br"}
PAGE = "struct<body:string,attachments:array<struct<title:string,url:string>>,grids:array<array<array<string>>>>"
PAGE_TYPE = pa.struct({"body": pa.string(), "attachments": pa.list_(pa.struct({"title": pa.string(), "url": pa.string()})), "grids": pa.list_(pa.list_(pa.list_(pa.string())))})


def shown(text: str) -> str:
    """Lines with single blanks, without empty ones."""
    return "\n".join(filter(None, (" ".join(line.split()) for line in text.split("\n"))))


class Walk(Tables):
    """Text and links of the whole page and of the first element of each container, and the page's tables."""

    def __init__(self, containers: Sequence[str]):
        super().__init__()
        self.containers = containers
        self.path: list[tuple[str, list[str]]] = []  # tag, and the containers that begin with it
        self.inside: list[str] = [""]
        self.text: dict[str, list[str]] = {"": []}
        self.links: dict[str, list[list]] = {"": []}
        self.link: list | None = None
        self.mute = 0

    def _put(self, data: str) -> None:
        if not self.mute:
            for name in self.inside:
                self.text[name].append(data)
            if self.link is not None:
                self.link[2].append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        given = dict(attrs)
        if tag in BLOCKS:
            self._put("\n")
        if tag in ("script", "style"):
            self.mute += 1
        if tag in VOID:
            return
        names = {tag, f"#{given['id']}" if given.get("id") else "", *(f".{c}" for c in (given.get("class") or "").split())} if given else (tag,)
        begins = [c for c in self.containers if c in names and c not in self.text]
        for name in begins:
            self.text[name], self.links[name] = [], []
            self.inside.append(name)
        self.path.append((tag, begins))
        if tag == "a":
            self.link = [given.get("href") or "", given.get("title") or "", []]
            for name in self.inside:
                self.links[name].append(self.link)

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        if tag in BLOCKS:
            self._put("\n")
        if tag == "a":
            self.link = None
        if any(t == tag for t, _ in self.path):
            closed = None
            while closed != tag:
                closed, ended = self.path.pop()
                self.inside = [n for n in self.inside if n not in ended]

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if not self.mute:
            self._put(re.sub(r"[\r\n]+", " ", data))  # lines are those of blocks


def unwrapped(token: str) -> str:
    """The address in a wrapper's token; '' when there is none."""
    part = (token.split(".") + [""])[1]
    try:
        said = base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)).decode("utf-8", "ignore").strip()
        given = json.loads(said) if said[:1] in ('{', '"') else said
    except (binascii.Error, ValueError):
        return ""
    target = str((given.get("url") or given.get("target") or "") if isinstance(given, dict) else given)
    target = unquote(target) if re.match("https?%3A%2F%2F", target, re.I) else target
    return target if re.match("https?://[^/]", target, re.I) else ""


def attachment_url(url: str, origin: str = "") -> str:
    """An address taken out of the portal's wrapper, or given back to the host whose path it is."""
    url = url.strip()
    parts = urlsplit(url)
    if not (parts.hostname or "").lower().endswith(PORTAL):
        return url
    if parts.path.endswith(WRAPPED) and (target := unwrapped(parse_qs(parts.query).get("target", [""])[0])):
        return target
    at = lambda scheme, host, path: urlunsplit((scheme, host, path, parts.query, ""))
    if parts.path.startswith(OWN_PATH):
        return at("http", HOME, parts.path)
    own = re.match(PREFIXED, parts.path)
    path, home = own[1] if own else parts.path, urlsplit(origin)
    if re.match(FOREIGN, path) and home.netloc:
        return at(home.scheme, home.netloc, path)
    return at("http", HOME, path) if path.startswith(GATEWAY) and not origin else url


def kept_attachment(title: str, url: str) -> bool:
    """Whether a link is no icon, advertisement or bare home page."""
    return not (re.search(JUNK, url, re.I) or title in NO_TITLES and re.match(BARE_HOME, url, re.I) or title in NO_PICTURE_TITLES and re.search(PICTURE, url, re.I))


def read_page(html: str, url: str, containers: Sequence[str] = CONTAINERS) -> dict:
    """Body, attachments and grids of one page."""
    walk = Walk(containers)
    walk.feed(html)
    walk.close()
    chosen = next((c for c in containers if c in walk.text), "")
    body = shown("".join(walk.text[chosen]))
    if len(body) < LEAST_TEXT:
        body = shown("".join(walk.text[""]))
    home = re.search(GOVERNMENT, body, re.I)
    files: dict[str, str] = {}
    for href, title, said in walk.links[chosen]:
        try:
            whole = urljoin(url, href.strip())
            target = attachment_url(whole, home[0] if home else "") if href and re.match("https?://", whole, re.I) else ""
        except ValueError:
            continue
        name = " ".join("".join(said).split()) or title.strip() or NAMELESS
        if target and target not in files and (re.search(FILE, target, re.I) or re.search(FILE_TITLE, name)) and kept_attachment(name, target):
            files[target] = name[:LONGEST_TITLE]
    return {"body": body[:MOST_TEXT], "attachments": [{"title": t, "url": u} for u, t in list(files.items())[:MOST_FILES]], "grids": walk.filled()}


def detail_page(html: Column, url: Column, source: Column | None = None, adapters: Mapping[str, Sequence[str]] | None = None) -> Column:
    """struct(body, attachments, grids) of a page; ``adapters`` gives the containers of a source, others have the usual ones."""

    @F.arrow_udf(PAGE)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = lambda p: read_page(p["html"] or "", p["url"] or "", (adapters or {}).get(p["source"], CONTAINERS))
        for pages in batches:
            yield mapped(pages, of, PAGE_TYPE)

    return read(F.struct(html.alias("html"), url.alias("url"), (source if source is not None else F.lit("")).alias("source")))
