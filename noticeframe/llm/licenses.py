"""Operator 6: license texts by winnowed fingerprints and banded alignment.

Templates are fingerprinted by winnowing: of every ``WINDOW`` consecutive hashes of ``GRAM`` words the
least is kept (of a notice, every hash: it is too short to lose any). What shares no ``GRAM`` words in a row with a
template is not found. An inverted index from fingerprint to template places picks, for each document, the places
where fingerprints of a template lie in a chain, each at most ``SPREAD`` words off the one before; a chain with too few different fingerprints for the
template's length is no candidate. Around the chain's diagonals a banded local
alignment of words (match 2, mismatch and gap -1) tells which of the template's words the document has in order,
and the span they cover. A span counts when

* it has ``LEAST_COVERAGE`` of the template's words,
* its distinguishing words (``FAMILY``: the words that make another license of it) are the template's, in order,
* and for a notice, a template of less than ``NOTICE`` words, its version numbers are too, and no negation stands in or right before it.

Of overlapping spans the one with more matched words stays, then the one with the higher coverage, then the first by
name.

The templates are a fixed small set, sent with the code; documents are read once and never shuffled.
Null and empty texts and an empty table give no rows; repeated rows are scanned each; extra columns are not read. A very long
text costs its words once, and alignments only where chains are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .hashing import WordHashes, mixed, rolled

GRAM, WINDOW, BAND, SPREAD, LEAST_COVERAGE, NOTICE = 3, 3, 8, 64, 0.8, 40
#: A chain needs one fingerprint in so many words of the template.
WORDS_A_SEED = 12
FAMILY = frozenset(w.encode() for w in "lesser library affero nc noncommercial sa sharealike nd noderivatives noderivs".split())
NEGATION, BEFORE = frozenset((b"not", b"never", b"isn", b"aren", b"wasn", b"without", b"neither")), 3

_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with {3}. If not, see http://www.gnu.org/licenses/."


def public_licenses() -> dict[str, str]:
    """Texts, headers and notices of public licenses by name."""
    found = {
        "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
        "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "MIT-notice": "Released under the MIT License.",
        "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "BSD-2-Clause": f"{_CLAUSES} {_DISCLAIMER}",
        "BSD-3-Clause": f"{_CLAUSES} {_NAMES} {_DISCLAIMER}",
        "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    }
    for short, word, versions in (("GPL", "", ("2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))):
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            found[f"{name}-notice"] = f"This work is licensed under the GNU {word}General Public License, version {v}."
            found[f"{name}-header"] = _GNU.format("This program" if short != "LGPL" else "This library", word, v, "this program" if short != "LGPL" else "this library")
    parts = {"BY": "", "BY-SA": "-ShareAlike", "BY-ND": "-NoDerivatives", "BY-NC": "-NonCommercial", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}
    for v, scope in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        for short, long in parts.items():
            found[f"CC-{short}-{v}-notice"] = f"Licensed under CC {short} {v}."
            found[f"CC-{short}-{v}-statement"] = f"This work is licensed under a Creative Commons Attribution{long} {v} {scope} License."
    return found


TEMPLATES = public_licenses()
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[bytes]:
    """Lower-case words."""
    found = WORD.findall(text)
    return "\n".join(found).lower().encode("utf-8", "surrogatepass").split(b"\n") if found else []


def winnow(grams, window: int = WINDOW) -> list[tuple[int, int]]:
    """``(hash, place)`` of the least hash of every window, the last of equals."""
    import numpy as np

    n = len(grams)
    if n <= window:
        return [(int(grams.min()), int(grams.argmin()))] if n else []
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    places = np.unique(np.arange(n - window + 1) + window - 1 - views[:, ::-1].argmin(axis=1))
    return list(zip(grams[places].tolist(), places.tolist()))


def versions(words: list[bytes]) -> list[bytes]:
    """Numbers in order; digits that follow each other are one number, and 3.0 is 3."""
    out, run = [], []
    for w in [*words, b""]:
        if w.isdigit():
            run.append(w)
        elif run:
            while len(run) > 1 and run[-1] == b"0":
                run.pop()
            out.append(b".".join(run))
            run = []
    return out


def same_license(template: list[bytes], words: list[bytes], first: int, stop: int) -> bool:
    """Whether the words from ``first`` to ``stop`` can be the template's license and no other."""
    inside = words[first:stop]
    if [w for w in template if w in FAMILY] != [w for w in inside if w in FAMILY]:
        return False
    if len(template) >= NOTICE:
        return True
    return versions(template) == versions(inside) and not NEGATION.intersection(words[max(0, first - BEFORE) : stop])


def align(template, words, low: int, high: int) -> tuple[int, int, int, int]:
    """``(score, matched, first, stop)`` of the best local alignment on the diagonals ``low`` to ``high``.

    Both are arrays of word numbers; a diagonal is document place minus template place. Rows are template
    words; a row is one array operation, gaps along it a running maximum.
    """
    import numpy as np

    width, n = high - low + 1, len(template)
    steps = np.arange(width, dtype=np.int32)
    h = np.zeros((n + 1, width + 1), dtype=np.int32)  # h[i + 1, d]: ends at template word i on diagonal low + d
    for i in range(n):
        places = steps + (i + low)
        there = (places >= 0) & (places < len(words))
        same = np.zeros(width, dtype=bool)
        same[there] = words[places[there]] == template[i]
        cell = np.maximum(0, h[i, :-1] + np.where(same, 2, -1))
        cell = np.maximum(cell, h[i, 1:] - 1)
        cell = np.where(there, cell, 0)
        h[i + 1, :-1] = np.where(there, np.maximum.accumulate(cell + steps) - steps, 0)
    i, d = np.unravel_index(int(h[:, :-1].argmax()), (n + 1, width))
    i, d, score, matched = int(i), int(d), int(h[i, d]), 0
    stop = first = i - 1 + low + d + 1
    while i > 0 and h[i, d] > 0:
        at = i - 1 + low + d
        same = 0 <= at < len(words) and words[at] == template[i - 1]
        if h[i, d] == max(0, h[i - 1, d] + (2 if same else -1)):
            if same:
                matched, first = matched + 1, at
            i -= 1
        elif d + 1 < width and h[i, d] == h[i - 1, d + 1] - 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return score, matched, first, stop


class LicenseIndex:
    def __init__(self, templates: dict[str, str]):
        import numpy as np

        self.known, self.numbers = WordHashes(), {}
        self.names, self.words, self.coded, self.index = list(templates), [], [], {}
        for t, name in enumerate(self.names):
            parts = words_of(templates[name])
            self.words.append(parts)
            self.coded.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in parts]))
            for h, place in winnow(mixed(rolled(self.known.of(parts), min(GRAM, len(parts)))), 1 if len(parts) < NOTICE else WINDOW):
                self.index.setdefault(h, []).append((t, place))
        self.marks = np.array(sorted(self.index), dtype=np.uint64)
        self.needed = [max(1, len(w) // WORDS_A_SEED) for w in self.words]

    def chains(self, t: int, seeds: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """``(low, high)`` diagonals of chains of ``(document place, template place)`` with enough different template places."""
        n, open_ = len(self.words[t]), []
        for j, place in sorted(seeds):
            d = j - place
            for chain in open_:
                if abs(chain["last"] - d) <= SPREAD and j - chain["at"] <= n + SPREAD:
                    chain["places"].add(place)
                    chain["low"], chain["high"], chain["last"], chain["at"] = min(chain["low"], d), max(chain["high"], d), d, j
                    break
            else:
                keep = []
                for chain in open_:
                    if j - chain["at"] <= n + SPREAD:
                        keep.append(chain)
                    elif len(chain["places"]) >= self.needed[t]:
                        yield chain["low"], chain["high"]
                open_ = [*keep, {"places": {place}, "low": d, "high": d, "last": d, "at": j}]
        for chain in open_:
            if len(chain["places"]) >= self.needed[t]:
                yield chain["low"], chain["high"]

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(name, coverage, matched, start, stop)`` by start; offsets in code points."""
        import numpy as np

        parts = words_of(text)
        if len(parts) < GRAM:
            return []
        grams = mixed(rolled(self.known.of(parts), GRAM))
        hit = np.flatnonzero(np.isin(grams, self.marks))
        if not len(hit):
            return []
        seeds: dict[int, list[tuple[int, int]]] = {}
        for j in hit.tolist():
            for t, place in self.index[int(grams[j])]:
                seeds.setdefault(t, []).append((j, place))
        spans, coded = [], None
        for t, own in seeds.items():
            for low, high in self.chains(t, own):
                coded = np.array([self.numbers.get(w, -1) for w in parts]) if coded is None else coded
                spans += self.spans(t, coded, parts, low - BAND, high + BAND)
        if not spans:
            return []
        kept: list[tuple] = []
        for span in sorted(set(spans), key=lambda s: (-s[0], -s[1], self.names[s[4]], s[2])):
            if all(span[3] <= a or span[2] >= b for _, _, a, b, _ in kept):
                kept.append(span)
        places = [m.span() for m in WORD.finditer(text)]
        return [(self.names[t], coverage, matched, places[a][0], places[b - 1][1]) for matched, coverage, a, b, t in sorted(kept, key=lambda s: s[2])]

    def spans(self, t: int, coded, parts: list[bytes], low: int, high: int) -> Iterator[tuple[int, float, int, int, int]]:
        """Spans of a template on a band that the rules accept; what lies beside an alignment is aligned again."""
        template, rest = self.coded[t], [(max(0, low), min(len(parts), high + len(self.words[t])))]
        near = set(parts[slice(*rest[0])])
        if sum(w in near for w in self.words[t]) < LEAST_COVERAGE * len(template):
            return
        while rest:
            a, b = rest.pop()
            score, matched, first, stop = align(template, coded[a:b], max(low - a, 1 - len(template)), min(high - a, b - a - 1)) if b > a else (0, 0, 0, 0)
            if matched < LEAST_COVERAGE * len(template):
                continue
            first, stop = first + a, stop + a
            rest += [(a, first), (stop, b)]
            if same_license(self.words[t], parts, first, stop):
                yield matched, matched / len(template), first, stop, t


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, license, coverage, matched_words, start, stop)`` per span."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = LicenseIndex(templates)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, coverage, matched, a, b in index.scan(t):
                    for col, v in zip(out, (k, name, coverage, matched, a, b)):
                        col.append(v)
            kinds = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(out, kinds)], names=[key, "license", "coverage", "matched_words", "start", "stop"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), whole_text(text).alias(text)).mapInArrow(
        run, f"`{key}` {kind}, license string, coverage double, matched_words long, start long, stop long"
    )
