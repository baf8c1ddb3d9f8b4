"""Whether a row's majors fit a wanted one.

A wanted major becomes a profile on the driver: the words that name it, the umbrella classes that hold it, and the
roles that suit it or rule it out. The vocabulary is the caller's; a row is then judged by built-in
expressions, with the profile as literals.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_keyword, spaced, trimmed

# Texts that ask for no particular major, separators of clauses, codes before a stored major.
UNLIMITED = "专业不限|不限专业|不限所学专业|无专业限制|^(?:不限|无限制|所有专业|各专业均可)$"
SEPARATORS = "[\\s,，、;/；:：。()（）【】\\[\\]“”\"'或]+"
CODE = spaced(r"^\d{4,6}[A-Za-z]?\s*(?=[一-龥])")


@dataclass(frozen=True)
class MajorProfile:
    """One wanted major. ``exact`` words count as a whole clause, alone or before 类 or 学; the others anywhere."""

    words: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    broad_exact: tuple[str, ...] = ()
    off_track: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()


def profiles(query: str, vocabulary: Mapping[str, MajorProfile], aliases: Mapping[str, Sequence[str]] | None = None) -> list[MajorProfile]:
    """The profiles of a query's terms; an unknown term, or a term of two letters or less, names itself."""
    out = []
    for term in dict.fromkeys(t for t in re.split(r"[\s,，、;/；]+", query.strip().lower()) if t):
        known = vocabulary.get(term) or next((vocabulary[k] for k, names in (aliases or {}).items() if term in names and k in vocabulary), None)
        short = term.isascii() and len(term) <= 3
        out.append(known or MajorProfile(words=() if short else (term,), exact=(term,) if short else (), roles=(term,)))
    return out


def is_unlimited(text: Column) -> Column:
    """no particular major is asked for."""
    return trimmed(text).rlike(UNLIMITED)


def clause_tokens(text: Column) -> Column:
    """Lower-case clauses, and those that end in 专业 also without it."""
    parts = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")
    bare = F.transform(F.filter(parts, lambda t: t.endswith("专业") & (F.char_length(t) > 2)), lambda t: F.substr(t, F.lit(1), F.char_length(t) - 2))
    return F.array_distinct(F.concat(parts, bare))


def stored_majors(majors: Column, noise: str | None = None, known: Sequence[str] = ()) -> Column:
    """Stored majors without codes, blanks and words that are none."""
    clean = F.filter(F.transform(F.coalesce(majors, F.array().cast("array<string>")), lambda m: trimmed(F.regexp_replace(trimmed(m), CODE, ""))), lambda m: m != "")
    return clean if noise is None else F.filter(clean, lambda m: is_unlimited(m) | ~m.rlike(noise) | F.lower(m).isin(*known))


def _named(text: Column, tokens: Column, words: Sequence[str], exact: Sequence[str]) -> Column:
    anywhere = [F.contains(text, F.lit(w)) for w in words]
    whole = [F.arrays_overlap(tokens, F.array(*[F.lit(x) for e in exact for x in (e, f"{e}类", f"{e}学")]))] if exact else []
    return reduce(lambda a, b: a | b, [*anywhere, *whole], F.lit(False))


def role_fits(role: Column, profile: MajorProfile) -> Column:
    """A role's title has one of the profile's words, ASCII ones between boundaries."""
    return F.coalesce(reduce(lambda a, b: a | b, [has_keyword(role, k) for k in profile.roles], F.lit(False)), F.lit(False))


def off_track(role: Column, profile: MajorProfile) -> Column:
    """A role that every one of the profile's patterns rules out."""
    text = F.lower(F.coalesce(role, F.lit("")))
    return F.lit(False) if not profile.off_track else (text != "") & reduce(lambda a, b: a & b, [text.rlike(p) for p in profile.off_track])


def fits(majors: Column, role: Column, profile: MajorProfile, include_unlimited: bool = False) -> Column:
    """F9 for one profile: named directly; else by a broad class unless the role is off the track; else by no limit; else by the role alone."""
    named = F.filter(majors, lambda m: ~is_unlimited(m))
    text = F.lower(F.array_join(named, " 、 "))
    tokens = clause_tokens(text)
    suits = role_fits(role, profile)
    free = F.exists(majors, is_unlimited) & (F.lit(include_unlimited) | suits)
    direct = _named(text, tokens, profile.words, profile.exact)
    broad = _named(text, tokens, profile.broad, profile.broad_exact) & (suits | ~off_track(role, profile))
    return F.when(F.size(named) > 0, direct | broad | free).when(F.size(majors) > 0, free).otherwise(suits)


def matches_major(majors: Column, role: Column, wanted: Sequence[MajorProfile], include_unlimited: bool = False) -> Column:
    """any wanted profile fits; no profile wants nothing."""
    clean = stored_majors(majors)
    return reduce(lambda a, b: a | b, [fits(clean, role, p, include_unlimited) for p in wanted]) if wanted else F.lit(True)


def concrete_match(terms: Sequence[str], majors: Column, role: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The first term that occurs in the majors or the role, else the first alias that is a clause; else null."""
    text, name = F.lower(F.coalesce(majors, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    tokens = clause_tokens(text)
    said = [F.when(F.contains(text, F.lit(t)) | F.contains(name, F.lit(t)), t) for t in terms]
    other = [F.when(F.array_contains(tokens, a.lower()), a) for t in terms for a in aliases.get(t, ())]
    return F.coalesce(*said, *other, F.lit(None).cast("string"))


def categories_of(explicit: str, terms: Sequence[str], groups: Mapping[str, Sequence[str]], aliases: Mapping[str, Sequence[str]]) -> list[str]:
    """The named group, and the groups of all terms it does not hold itself."""
    found = [explicit] if explicit in groups else []
    lower = {g: {m.lower() for m in ms} for g, ms in groups.items()}
    for term in terms:
        names = {term, *(a.lower() for a in aliases.get(term, ()))}
        if not (found and found[0] == explicit and names & lower[explicit]):
            found += [g for g in groups if g not in found and names & lower[g]]
    return found


def sibling_match(categories: Sequence[str], majors: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Another major of the same groups is asked for; names of three characters or less only as a clause."""
    text = F.lower(F.coalesce(majors, F.lit("")))
    members = [m.lower() for c in categories for m in groups.get(c, ())]
    return _named_whole(text, [m for m in members if len(m) > 3], [m for m in members if len(m) <= 3])


def _named_whole(text: Column, words: Sequence[str], whole: Sequence[str]) -> Column:
    tests = [F.contains(text, F.lit(w)) for w in words]
    if whole:
        tests.append(F.arrays_overlap(clause_tokens(text), F.array(*map(F.lit, whole))))
    return reduce(lambda a, b: a | b, tests, F.lit(False))
