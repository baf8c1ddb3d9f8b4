"""Text rules: normal forms, search text, display forms, markup and escaping."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of legal forms and notices that normal forms drop.
LEGAL_FORMS = "有限责任公司|股份有限公司|有限公司|集团有限公司|集团"
BRANCHES = "分行|支行|分公司|中心|办事处"
NOTICE_WORDS = "校园招聘(?:简章|公告|启事)?|招聘(?:简章|公告|启事|信息)?|简章|公告|启事|专场"

EMAIL = r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"


#: White space of notices beyond what Java's ``\\s`` and Spark's ``trim`` know: full-width and no-break blanks, line ends, the byte-order mark.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def spaced(pattern: str) -> str:
    """A pattern in which ``\\s`` and ``\\S`` stand for ``WHITE`` and all else, inside and outside of classes."""
    signs = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
    out, inside = [], False
    for part in re.findall(r"\\.|\[\^?\]?|[^\\\[]", pattern, re.S):
        if part == r"\s":
            part = signs if inside else f"[{signs}]"
        elif part == r"\S" and not inside:
            part = f"[^{signs}]"
        elif part.startswith("["):
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return "".join(out)


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def trimmed_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replaced(text: Column, *rules: tuple[str, str]) -> Column:
    """Apply regular-expression replacements in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def _tight(text: Column) -> Column:
    return replaced(F.coalesce(text, F.lit("")), (spaced(r"\s+"), ""), ("（", "("), ("）", ")"))


def company_norm(name: Column) -> Column:
    """No spaces, half-width brackets, no legal form unless text other than a branch follows."""
    return replaced(
        _tight(name),
        (r"\((?:中国|集团|有限|股份|分公司|有限责任).*?\)", ""),
        (rf"(?:{LEGAL_FORMS})(?=(?:[一-龥]{{2,10}}?(?:{BRANCHES}))?$)", ""),
    )


def title_core(title: Column) -> Column:
    """Without a leading bracketed tag and a trailing notice word."""
    return replaced(_tight(title), (r"^[【\[(][^】\])]{1,20}[】\])]", ""), (rf"(?:{NOTICE_WORDS})$", ""), (r"(20\d{2})年$", "$1"))


def canonical(name: Column) -> Column:
    """Compatibility form with single spaces. NFKC has no built-in: a Pandas UDF."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return trimmed(F.regexp_replace(nfkc(name), spaced(r"\s+"), " "))


def trimmed_excerpt(text: Column, limit: int = 90) -> Column:
    """At most ``limit`` code points, the last an ellipsis when cut."""
    return F.when(F.char_length(text) > limit, F.concat(trimmed_end(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def search_text(*parts: Column) -> Column:
    """P5: lower-cased parts, null parts left out."""
    return F.lower(F.concat_ws(" ", *parts))


def search_head_tail(head: Column, tail: Column, head_cap: int = 240, tail_cap: int = 320, cap: int = 480, lower_tail: bool = False) -> Column:
    """The lower-cased head and a tail that, as a kept quirk, is lower-cased only on demand."""
    end = F.substring(F.coalesce(tail, F.lit("")), 1, tail_cap)
    whole = F.concat_ws(" ", F.substring(F.lower(head), 1, head_cap), F.lower(end) if lower_tail else end)
    return F.substring(trimmed(whole), 1, cap)


def contains_all(text: Column, query: str, limit: int = 5) -> Column:
    """every term of the query occurs; terms are split at white space, at most ``limit``."""
    terms = query.lower().split()[:limit]
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in terms], F.lit(True))


def has_keyword(text: Column, keyword: str) -> Column:
    """ASCII keywords match between non-alphanumerics, others anywhere."""
    word = keyword.lower()
    if word.isascii():
        quoted = "".join("\\" + c if not c.isalnum() else c for c in word)
        return F.lower(text).rlike(f"(?:^|[^a-z0-9]){quoted}(?:$|[^a-z0-9])")
    return F.contains(F.lower(text), F.lit(word))


def redacted(text: Column) -> Column:
    """E-mail addresses and mainland mobile numbers."""
    return replaced(text, (EMAIL, "[email]"), (MOBILE, "[phone]"))


#: Named entities that plain text gets decoded, besides blanks and the ampersand, which comes last.
ENTITIES = "lt gt quot apos copy reg trade hellip mdash ndash ldquo rdquo lsquo rsquo laquo raquo middot bull times deg euro".split()


def plain_html(html: Column) -> Column:
    """Text of markup: no scripts or styles, blocks become lines, common entities decoded."""
    bare = replaced(html, (r"(?is)<(script|style)[^>]*>.*?</\1>", ""), (r"(?s)<!--.*?-->", ""), (spaced(r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol|article|section)>"), "\n"), (r"(?s)<[^>]*>", " "))
    for name, char in (("&nbsp;", " "), ("&#39;", "'"), *((f"&{n};", html5[f"{n};"]) for n in ENTITIES), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return replaced(bare, (r"[ \t\x0B\f\r]+", " "), (spaced(r" ?\n\s*"), "\n"), (spaced(r"^\s+|\s+$"), ""))


def safe_url(url: Column) -> Column:
    """Http and https only; user names, fragments and spaces rejected or dropped; else null."""
    clean = F.regexp_replace(trimmed(url), "#.*$", "")
    return F.when(clean.rlike(spaced(r"(?i)^https?://[^\s/@]+(?:/\S*)?$")), clean)


def ics_escaped(text: Column) -> Column:
    """Calendar text escapes."""
    return replaced(F.coalesce(text, F.lit("")), (r"\\", r"\\\\"), (";", r"\\;"), (",", r"\\,"), (r"\r\n|\r|\n", r"\\n"))


def xml_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def fold_lines(line: Column, octets: int = 75) -> Column:
    """K7: calendar folding by octets, never inside a character: a Pandas UDF."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            out, size, limit = [], 0, octets
            for c in v:
                n = len(c.encode())
                if size + n > limit:
                    out.append("\r\n ")
                    size, limit = 0, octets - 1
                out.append(c)
                size += n
            return "".join(out)

        return s.map(one)

    return fold(line)


def fingerprint(*parts: Column, digits: int = 64) -> Column:
    """SHA-256 over the JSON of the parts; arrays should come sorted."""
    return F.substring(F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256), 1, digits)


def char_overlap(a: Column, b: Column) -> Column:
    """Shared characters over the smaller set of characters (a bag-free similarity)."""
    sets = [F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")) for c in (a, b)]
    least = F.greatest(F.lit(1), F.least(*[F.size(s) for s in sets]))
    return F.size(F.array_intersect(*sets)) / least
