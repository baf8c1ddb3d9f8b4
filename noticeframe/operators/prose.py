"""Majors that running text asks for, and the vocabulary search behind it.

A vocabulary becomes one automaton (a trie with failure links), built once per task however many texts follow; a text is
then read once, whatever the number of words. Majors come from four passes in order: a general lack of limits, labelled
lines, labelled blocks of lines, and phrases that end in a word for related majors. The vocabulary of known majors and of
stems is the caller's. Texts stay where they are: there is no shuffle.

Null texts give empty lists. An empty vocabulary finds nothing (but a lack of limits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..batches import mapped

# Labels, where a labelled block stops, and words for related majors with what may not follow.
UNLIMITED = "专业不限"
NO_LIMIT = "专业不限|不限专业|不限所学专业|无专业限制"
NO_LIMIT_WHOLE = f"{NO_LIMIT}|不限|无限制|所有专业|各专业均可"
NO_LIMIT_PART = "不限|无限制|专业不限|不限专业"
NO_LIMIT_LINE = rf"(?:{NO_LIMIT}|(?:专业要求|需求专业|所学专业|招聘专业|专业范围|专业类别|专业条件|专业)\s*[:：]\s*(?:不限|无限制|均可|不限专业|专业不限)(?=$|[\s，,。；;（()）]))"
LABELLED = (
    r"(?:^|[\n；;。！!？?｜|•·*◆●])\s*(?:\(?[一二三四五六七八九十\d]+[、.．)）]\s*)?【?\s*(?:专业要求|需求专业|所学专业|招聘专业|专业范围|专业方向|专业类别|学科专业|专业条件|专业背景|对口专业|专业)\s*】?\s*"
    r"(?:[:：]|(?:为|是|限|包括)(?![^\n。；;]{0,6}[:：]))\s*([^\n。！!？?]{2,180})"
)
BLOCK = r"(?:^|\n)\s*[*◆●•·-]?\s*(?:【\s*(?:校招岗位及)?(?:专业要求|需求专业|所学专业|招聘专业|专业范围|专业类别)\s*】|(?:专业要求|需求专业|所学专业|招聘专业)\s*[:：]?)\s*\n((?:[^\n]{2,160}\n?){1,6})"
BLOCK_STOP = (
    r"\s*[*◆●•·-]?\s*【?\s*(?:招聘信息|职位描述|岗位职责|工作职责|工作内容|任职要求|任职资格|招聘条件|应聘条件|报名条件|基本条件|福利待遇|公司福利|薪酬福利|薪资待遇|薪资|投递方式|报名方式|应聘方式|联系方式|公司简介|单位简介|"
    "企业简介|关于我们|注意事项)"
)
RELATED = (
    r"([A-Za-z一-龥/／、，,\s&＆（）()与及和或]{2,100}?)(?:及相关专业|相关专业|类相关专业|等专业|类等专业|类专业|专业优先|专业毕业|专业应届|方向专业)"
    "(?!知识|技能|能力|水平|素养|术语|软件|工具|标准|法规|制度|培训|实务|人员|人士|人才|技术职务|资格|考试|认证|工作)"
)
# What a part of a chunk loses, in order.
LOSES = (
    (r"（[^）]{24,}）|\([^)]{24,}\)", " "),
    (r"^\s*(?:\(?[一二三四五六七八九十\d]+[、.．)）]\s*)+", ""),
    (r"^\s*\d{4,6}[A-Za-z]?\s*(?=[一-龥])", ""),
    ("^.*?(?:我们希望你来自|如果你是|主要面向|主要招收|招聘专业为|所学专业为|需求专业为|专业要求为|专业为|专业是|专业限)", ""),
    (r"^(?:全日制|统招|普通高校|国内外|境内外|应届|往届|202\d届|毕业生|研究生|博士|硕士|本科|大专|专科|学士|及以上|以上|学历|学位)+", ""),
    (r"^(?:面向[^\s，,、]{0,12})?(?:招收|招聘|诚聘|欢迎|吸纳|面向|限|要求|具有|具备|主修|所学|以)", ""),
    ("(?:等相关|及相关|类相关|相关|等专业|方向|背景|学历|毕业|应届毕业生|应届生|学生|优秀人士|人才|优先考虑|优先|为主|均可|皆可|等)+$", ""),
    ("专业$", ""),
    ("(?:等相关|及相关|类相关|相关|等)+$", ""),
    (r"^[（(()）【】[\]·•*◆●—:：\s-]+|[（(()）【】[\]·•*◆●—:：\s-]+$", ""),
    ("^[与及和或]+", ""),
)
PARTS = r"[\s,，、;/／；｜|或&＆:：（）()]+"
# Short names of degrees and fields, words that no major has, endings of posts, and prefixes that say nothing.
SHORT_NAMES = "cpa|acca|cfa|frm|mpacc|maud|mba|mpa|mem|jm|llm|cs|se|ee|ic|ai|gis"
NO_MAJOR = (
    "能力|经验|知识(?!产权)|技能|水平|精神|态度|素质|素养|意识|责任|热爱|熟悉|掌握|精通|了解|熟练|具备|具有|能够|良好|较强|优秀|身体|健康|年龄|周岁|性别|户籍|工作地|地点|服从|接受|出差|倒班|实习|薪资|待遇|福利|五险|双休|补贴|住宿|"
    "证书|资格证|考试|认证|执业|职称|职责|描述|内容|贯彻|落实|遵守|法律法规|规章制度|招聘|简章|公司|集团|企业|单位|部门|人数|名额|序号|备注|联系方式|电话|邮箱|网址|报名|投递|面试|笔试|条件|岗位|职位|我们|希望|如果|你是|来自|只要|"
    "浓厚|兴趣|从事|工作|业务范围|涵盖|扎实|通过|部分|方向$|以上|以下|左右|不限"
)
POST_END = "(?:工程师|经理|主管|总监|主任|技术员|办事员|柜员|专员|助理|顾问|代表|营销服务|开发岗|管理岗)$"

LIMIT, CAP = 20, 12_000
#: Parts of chunks that a task remembers: notices name the same majors again and again.
REMEMBERED = 20_000
SHORTEST, LONGEST = 2, 22


class Vocabulary:
    """An automaton over words: one pass over a text finds them all."""

    def __init__(self, words: Sequence[str]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for word in filter(None, words):
            self.found.add_word(word, word)
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()

    def longest(self, text: str) -> list[str]:
        """Leftmost words that do not overlap, each the longest at its place."""
        if self.empty:
            return []
        at: dict[int, str] = {}
        for end, word in self.found.iter(text):
            start = end - len(word) + 1
            if len(word) > len(at.get(start, "")):
                at[start] = word
        out, free = [], 0
        for start in sorted(at):
            if start >= free:
                out.append(at[start])
                free = start + len(at[start])
        return out

    def any_in(self, text: str) -> bool:
        return not self.empty and next(self.found.iter(text), None) is not None


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Leftmost longest occurrences of the words, in the order of the text."""

    @F.arrow_udf("array<string>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(words)
        for texts in batches:
            yield mapped(texts, lambda t: vocabulary.longest(t or ""), pa.list_(pa.string()))

    return search(text)


@dataclass(frozen=True)
class MajorWords:
    """``known`` majors, in lower case, and ``stems`` that make any name with them a major's."""

    known: frozenset[str] = frozenset()
    stems: tuple[str, ...] = ()


@dataclass
class Reader:
    """What one task needs to read texts: the automaton, the patterns, and the parts that it has just judged."""

    words: MajorWords
    limit: int = LIMIT
    stems: Vocabulary = field(init=False)

    def __post_init__(self):
        self.stems = Vocabulary(self.words.stems)
        self.loses = [(re.compile(pattern).sub, instead) for pattern, instead in LOSES]
        self.without_limit, self.wholly, self.partly = re.compile(NO_LIMIT).search, re.compile(NO_LIMIT_WHOLE).fullmatch, re.compile(NO_LIMIT_PART).fullmatch
        self.short_name, self.no_major, self.post_end = re.compile(SHORT_NAMES, re.I).fullmatch, re.compile(NO_MAJOR).search, re.compile(POST_END).search
        self.sentences, self.parts, self.degrees = re.compile("[。！？!?]").split, re.compile(PARTS).split, re.compile("及以上(?:学历)?").sub
        self.no_limit_line, self.labelled, self.blocks, self.stops, self.related = (re.compile(p) for p in (NO_LIMIT_LINE, LABELLED, BLOCK, BLOCK_STOP, RELATED))
        self.major = lru_cache(REMEMBERED)(self.judged)

    def plausible(self, name: str) -> bool:
        """Whether a cleaned part is a major: no limit at all, a short name, a known one, or one with a stem and nothing against it."""
        if self.without_limit(name) or self.wholly(name) or self.short_name(name):
            return True
        if not SHORTEST <= len(name) <= LONGEST or name.isdecimal():
            return False
        if name.lower() in self.words.known:
            return True
        return not self.no_major(name) and not self.post_end(name) and self.stems.any_in(name)

    def cleaned(self, part: str) -> str:
        for lose, instead in self.loses:
            part = lose(instead, part)
        part = part.strip()
        for opening, closing in ("（）", "()"):
            if opening in part and closing not in part:
                part = part.split(opening)[0].strip()
        return part

    def judged(self, part: str) -> str:
        """The major that a part of a chunk names; '' for none."""
        if self.partly(part.strip()):
            return UNLIMITED
        name = self.cleaned(part)
        return name if name and self.plausible(name) else ""

    def of_chunk(self, chunk: str) -> Iterator[str]:
        """The majors that a chunk of text lists, up to its first sentence's end."""
        said = self.sentences(self.loses[0][0](" ", chunk))[0]
        if self.without_limit(said) or self.wholly(said.strip()):
            yield UNLIMITED
        yield from filter(None, map(self.major, self.parts(self.degrees(" ", said))))

    def chunks(self, text: str) -> Iterator[str]:
        """Chunks of the labelled lines, then of the blocks, then of the phrases."""
        for m in self.labelled.finditer(text):
            yield m[1]
        for m in self.blocks.finditer(text):
            for line in m[1].split("\n"):
                if self.stops.match(line):
                    break
                yield line
        for m in self.related.finditer(text):
            last = re.split("[；;：:\n]", m[1])[-1] or m[1]
            yield f"{last}类" if m[0].endswith("类专业") else last

    def majors(self, text: str) -> list[str]:
        if "专业" not in text and "学历" not in text:
            return []
        found = dict.fromkeys([UNLIMITED] if self.no_limit_line.search(text) else [])
        for chunk in self.chunks(text):
            for name in self.of_chunk(chunk):
                if len(found) >= self.limit:
                    return list(found)
                found[name] = None
        return list(found)


def prose_majors(text: Column, words: MajorWords, limit: int = LIMIT, cap: int = CAP) -> Column:
    """At most ``limit`` majors of a text's first ``cap`` characters, first found first."""

    @F.arrow_udf("array<string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(words, limit)
        for texts in batches:
            yield mapped(texts, lambda t: reader.majors((t or "")[:cap]), pa.list_(pa.string()))

    return read(text)
