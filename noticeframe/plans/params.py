"""Parameters as values, with clamps and a URL form."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from urllib.parse import parse_qs, urlencode


@dataclass(frozen=True)
class Query:
    """Parameters of the flat query; ``normalised`` clamps them."""

    cities: tuple[str, ...] = ()
    include_nationwide: bool = False
    type: str = ""
    sector: str = ""
    education: str = ""
    kind: str = ""
    min_salary: float | None = None
    q: str = ""
    sort: str = "newest"
    page: int = 1
    size: int = 20

    def normalised(self) -> Query:
        cities = tuple(dict.fromkeys(c.strip() for c in self.cities if c.strip()))[:8]
        return replace(
            self,
            cities=cities,
            q=self.q.strip()[:80],
            sort=self.sort if self.sort in ("newest", "deadline", "salary") else "newest",
            page=min(500, max(1, self.page)),
            size=min(50, max(1, self.size)),
            min_salary=self.min_salary if self.min_salary is None or self.min_salary >= 0 else None,
        )


@dataclass(frozen=True)
class Filters:
    """Content conditions of the workspace."""

    query: str = ""
    cities: tuple[str, ...] = ()
    include_nationwide: bool = False
    include_unknown: bool = True
    include_expired: bool = False
    position_level: bool = False
    kind: str = "全部"
    type: str = "全部"
    sector: str = "全部"
    direction: str = "全部"
    year: str = "全部"
    education: str = "全部"
    employment: str = "全部"
    provenance: str = "全部"
    min_salary: float = 0

    def active(self) -> int:
        """H9: number of conditions that differ from their defaults."""
        plain = Filters()
        return sum(getattr(self, f.name) != getattr(plain, f.name) for f in fields(self))


def to_url(params: Query | Filters) -> str:
    """Only what differs from the defaults, in field order."""
    plain, out = type(params)(), []
    for f in fields(params):
        value = getattr(params, f.name)
        if value == getattr(plain, f.name):
            continue
        for v in value if isinstance(value, tuple) else (value,):
            out.append((f.name, int(v) if isinstance(v, bool) else v))
    return urlencode(out)


def from_url(kind: type, text: str) -> Query | Filters:
    """Unknown names and malformed values are ignored."""
    found, given = parse_qs(text.lstrip("?")), {}
    for f in fields(kind):
        if f.name not in found:
            continue
        values, default = found[f.name], getattr(kind(), f.name)
        try:
            if isinstance(default, tuple):
                given[f.name] = tuple(values)
            elif isinstance(default, bool):
                given[f.name] = values[-1] in ("1", "true", "True")
            elif isinstance(default, int):
                given[f.name] = int(values[-1])
            elif default is None or isinstance(default, float):
                given[f.name] = float(values[-1])
            else:
                given[f.name] = values[-1]
        except ValueError:
            continue
    return kind(**given)
