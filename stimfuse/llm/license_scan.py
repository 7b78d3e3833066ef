"""License scans: winnowed fingerprints of templates in an inverted index, then banded sequence alignment.

Templates and texts are normalised to lower-case letters and digits with single spaces. Hashes of all GRAM-character strings of
a template are winnowed (the least of each window of WINDOW hashes is kept; short templates keep all), and all strings of a text
are looked up, so any shared stretch of GRAM + WINDOW - 1 characters (of GRAM, for short templates) shares a fingerprint. The
index maps fingerprints to (template, position) and is as large as the templates, which are a parameter. A hit proposes a
template at a diagonal; every diagonal that leads to another word is a candidate. A candidate is aligned word by word in a band
around its diagonal (match 1, mismatch and gap 0 with the longest common subsequence kept), and reported if the matched words are
at least `coverage` of the template and of the words between the first and the last of them, so inserted words count against it.

Words in braces in a template distinguish its license: each group of them has to stand in the text as it is, without gaps.
"Licensed under CC BY-NC-SA 4.0." is no match of "Licensed under CC {BY-NC 4.0}.", for all that its words are there.

Reports of one template that overlap keep the one that covers most, of equals the shortest; occurrences side by side are all
reported. Reports of different templates may overlap: a grant stands inside a whole license text.

Edge cases: null, empty and too short texts give no rows; texts of any length are scanned whole; repeated rows and repeated or
null ids are scanned alike, each row for itself; an empty table or no templates give no rows; other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stimfuse.llm.common import map_batches

#: Characters of a fingerprint, hashes of a window, words on either side of the diagonal.
GRAM, WINDOW, BAND = 12, 6, 6
#: Diagonals that are aligned together.
DIAGONALS = 2048
#: Words of a template whose matches are searched for every first and last word.
SHORT = 40

#: Notices, standard headers and texts of common public licenses, without the lines of their holders.
TEMPLATES = {
    "mit-notice": "Released under the {MIT} License.",
    "bsd-notice": "Released under the {BSD} License.",
    "isc-notice": "Released under the {ISC} License.",
    "apache-2.0-notice": "Licensed under the {Apache} License, Version {2.0}.",
    "gpl-3.0-notice": "This work is licensed under the {GNU General Public License}, version {3}.",
    "gpl-2.0-notice": "Licensed under the {GNU General Public License}, version {2}.",
    "lgpl-3.0-notice": "Licensed under the {GNU Lesser General Public License}, version {3}.",
    "agpl-3.0-notice": "Licensed under the {GNU Affero General Public License}, version {3}.",
    "cc-by-4.0-notice": "This work is licensed under a {Creative Commons Attribution 4.0} International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a {Creative Commons Attribution ShareAlike 4.0} International License.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a {Creative Commons Attribution NonCommercial 4.0} International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-2.0-short-notice": "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials {provided with the distribution. THIS SOFTWARE IS PROVIDED} BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote products derived from this software} without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation",
    "lgpl-grant": "This library is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser General Public License} as published by the Free Software Foundation",
    "agpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero General Public License} as published by the Free Software Foundation",
    "apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-header": "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}
# the short notices of the Creative Commons family, by a rule
TEMPLATES |= {f"cc-{kind}-{version}-notice" if (kind, version) != ("by", "4.0") else "cc-by-4.0-short-notice": f"Licensed under CC {{{kind.upper()} {version}}}." for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for version in ("2.0", "2.5", "3.0", "4.0")}

# identifiers in source files, and names that stand for a notice, by rules
TEMPLATES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {{{x}}}" for x in ("MIT", "MIT-0", "ISC", "Zlib", "Unlicense", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0", "BSL-1.0", "EPL-2.0", *(f"{g}-{v}-{k}" for g, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for k in ("only", "or-later")))}
TEMPLATES |= {f"{x.lower().replace(' ', '-')}-short-notice": f"Licensed under {{{x}}}." for x in ("GPLv2", "GPLv3", "LGPLv3", "AGPLv3", "Apache License 2.0", "Apache 2.0", "MPL 2.0")}
TEMPLATES |= {f"{x.lower()}-terms-notice": f"under the terms of the {{{x}}} License" for x in ("MIT", "BSD", "ISC", "Apache")}

_CLASS = np.zeros(256, np.uint8)  # bytes that are kept, lower-cased; others part words
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _CLASS[_c] = ord(chr(_c).lower())
    elif _c >= 0x80:
        _CLASS[_c] = _c
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and where each of them stands in raw; runs of other bytes are one space."""
    c = _CLASS[raw]
    keep = c > 0
    gap = np.flatnonzero(~keep & np.concatenate([[False], keep[:-1]]))
    at = np.concatenate([np.flatnonzero(keep), gap])
    at.sort()
    out = c[at]
    out[out == 0] = 32
    return out, at


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * _BASE + text[k : k + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are the least of some window; all, if there are fewer than a window."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.arange(len(h))
    low = h[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(low, h[k : k + n], out=low)
    kept = np.zeros(len(h), bool)
    for k in range(WINDOW):
        kept[k : k + n] |= h[k : k + n] == low
    return np.flatnonzero(kept)


def groups_of(template: str) -> list[tuple[int, int]]:
    """The groups of distinguishing words of a template, as (first, after the last) word."""
    n, out = 0, []
    for k, part in enumerate(re.split(r"[{}]", template)):
        words = len(normalised(np.frombuffer(part.encode(), np.uint8))[0].tobytes().split())
        if k % 2 and words:
            out.append((n, n + words))
        n += words
    return out


class Index:
    """The inverted index of winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words, self.groups, marks, place, template = [], [], [], [], []
        for i, name in enumerate(self.names):
            text, _ = normalised(np.frombuffer(templates[name].encode(), np.uint8))
            h = gram_hashes(text)
            at = winnow(h) if len(h) >= 4 * WINDOW else np.arange(len(h))
            self.words.append(text.tobytes().split())
            self.groups.append(groups_of(templates[name]))
            marks.append(h[at])
            place.append((np.cumsum(text == 32) - (text == 32))[at] if len(at) else at)  # the word before a gram that starts with a space, as in texts
            template.append(np.full(len(at), i))
        if not marks:
            marks, place, template = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for words in self.words for w in words}))}
        order = np.argsort(np.concatenate(marks), kind="stable")
        self.marks, self.word, self.template = np.concatenate(marks)[order], np.concatenate(place)[order], np.concatenate(template)[order]
        self.maybe = np.zeros(1 << 16, bool)  # by the last 16 bits of a hash: most strings of a text are told apart without a search
        self.maybe[(self.marks & np.uint64(0xFFFF)).astype(np.int64)] = True

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> dict[int, list[int]]:
        """Per template the distinct diagonals, in order: the word of the text (which begin at starts) that meets the template's first word."""
        h = gram_hashes(text)
        if not len(h) or not len(self.marks):
            return {}
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.marks, h[at], "left"), np.searchsorted(self.marks, h[at], "right")
        n = hi - lo
        mark = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        word = np.searchsorted(starts, np.repeat(at, n), side="right") - 1
        found = np.unique(np.stack([self.template[mark], word - self.word[mark]], 1), axis=0)
        return {int(t): found[found[:, 0] == t, 1].tolist() for t in np.unique(found[:, 0])}


def align(template: list[tuple[list[bytes], bool]], words: list[bytes], band: int) -> list[tuple[int, int]]:
    """Pairs (place in the template, place in words) of a longest common subsequence that stays within band of the diagonal, which
    begins band words after the first of words.

    The template is a list of (words, whether they are a group): single words, and groups that only match as a whole and weigh more
    than all the rest."""
    most, m, width = sum(len(part) for part, _ in template), len(words), 2 * band + 1
    weights = [len(part) * (most if group else 1) for part, group in template]
    best = [[0] * width]
    ends = []
    for i, (part, _) in enumerate(template):
        n = len(part)
        ends.append((ends[-1] if ends else 0) + n)
        weight, above, row = weights[i], best[i], [0] * width
        for b in range(width):
            j = ends[i] + b
            got = above[b + n] if b + n < width else 0
            if 1 <= j <= m:
                if b and row[b - 1] > got:
                    got = row[b - 1]
                if j >= n and part[-1] == words[j - 1] and (n == 1 or part == words[j - n : j]) and above[b] + weight > got:
                    got = above[b] + weight
            row[b] = got
        best.append(row)
    i, b, out = len(template), max(range(width), key=lambda x: (best[-1][x], -abs(x - band))), []  # of equals the nearest to the diagonal
    while i > 0 and best[i][b] > 0:
        part = template[i - 1][0]
        n, j = len(part), ends[i - 1] + b
        if n <= j <= m and part == words[j - n : j] and best[i][b] == best[i - 1][b] + weights[i - 1]:
            out += [(ends[i - 1] - 1 - k, j - 1 - k) for k in range(n)]
            i -= 1
        elif 1 <= j <= m and b and best[i][b] == best[i][b - 1]:
            b -= 1
        else:
            i, b = i - 1, b + n
            if b >= width:
                break
    return out[::-1]


def accepted(hits: list[tuple[int, int]], n_words: int, groups: list[tuple[int, int]], coverage: float) -> list[tuple[int, int]]:
    """The longest part of an alignment (of equals the one in fewest words) that covers enough of the template and of its own span
    and has every group of distinguishing words; empty if there is none."""
    least = max(1, int(np.ceil(coverage * n_words - 1e-9)))
    places = {i for i, _ in hits}
    if any(i not in places for a, b in groups for i in range(a, b)):
        return []
    for n in range(len(hits), least - 1, -1):
        parts = [hits[k : k + n] for k in range(len(hits) - n + 1)]
        parts = [x for x in parts if n >= coverage * (x[-1][1] - x[0][1] + 1) and all(x[0][0] <= a and b - 1 <= x[-1][0] for a, b in groups)]
        if parts:
            return min(parts, key=lambda x: x[-1][1] - x[0][1])
    return []


def best_part(parts: list, own: list[bytes], words: list[bytes], groups: list[tuple[int, int]], coverage: float) -> list[tuple[int, int]]:
    """The accepted part of an alignment. A longest one may hang on words far off that its span doesn't bear: then it is tried again
    from each word on that a match may begin with (what coverage leaves of the template has to follow), and for short templates up to
    each word that it may end with."""
    hits = align(parts, own, BAND)
    found = accepted(hits, len(words), groups, coverage)
    if found or len(hits) < coverage * len(words):
        return found
    heads = set(words[: len(words) - int(np.ceil(coverage * len(words) - 1e-9)) + 1])
    for s in [k for k, w in enumerate(own) if w in heads]:
        for e in (len(own), *(k for k in range(len(own), s, -1) if len(words) <= SHORT and own[k - 1] in words)):
            part = accepted(align(parts, [b""] * s + own[s:e], BAND), len(words), groups, coverage)
            if (len(part), -part[-1][1] + part[0][1] if part else 0) > (len(found), -found[-1][1] + found[0][1] if found else 0):
                found = part
            if e - s < coverage * len(words):
                break
    return found


def hopeful(numbers: np.ndarray, diagonals: np.ndarray, template: list[tuple[np.ndarray, bool]], least: int) -> np.ndarray:
    """The diagonals whose band may hold a match: in-band alignments of all of them are made together, row by row, and their weight is
    compared with that of every group and of `least` words. numbers: the text's words by number, 0 for words that no template has."""
    total, width = sum(len(part) for part, _ in template), 2 * BAND + 1
    grouped = sum(len(part) for part, group in template if group)
    needed = grouped * total + max(0, least - grouped)
    out = []
    padded = np.concatenate([np.zeros(total + 2 * BAND, np.int32), numbers, np.zeros(total + 2 * BAND + 1, np.int32)])
    for lo in range(0, len(diagonals), DIAGONALS):
        d = diagonals[lo : lo + DIAGONALS]
        words = padded[(d - BAND + total + 2 * BAND)[:, None] + np.arange(total + 2 * BAND)]
        best, end = np.zeros((len(d), width), np.int64), 0
        for part, group in template:
            n = len(part)
            end += n
            row = np.zeros_like(best)
            row[:, : width - n] = best[:, n:]
            same = np.ones((len(d), width), bool)
            for k in range(n):
                first = end - n + k
                same &= words[:, first : first + width] == part[k]
            np.maximum(row, np.where(same, best + n * (total if group else 1), 0), out=row)
            best = np.maximum.accumulate(row, axis=1)
        out.append(d[best.max(1) >= needed])
    return np.concatenate(out) if out else diagonals


def scan_text(raw: bytes, index: Index, coverage: float = 0.8) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of the matches in one text; start and end are byte positions.

    Only diagonals that hopeful() leaves are aligned one by one, and bands of equal words are aligned once, so a text that repeats a
    license over and over costs little more than one copy."""
    text, at = normalised(np.frombuffer(raw, np.uint8))
    gaps = np.flatnonzero(text == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(text))
    candidates = index.candidates(text, starts)
    if not candidates:
        return []
    tokens = [text[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    numbers = np.array([index.number.get(w, 0) for w in tokens], np.int32)
    found: dict[int, set[tuple[float, int, int]]] = {}
    known: dict[tuple, list[tuple[int, int]]] = {}
    for t, diagonals in candidates.items():
        words, groups = index.words[t], index.groups[t]
        inside = {a: b for a, b in groups}
        within = {i for a, b in groups for i in range(a + 1, b)}
        parts = [(words[i : inside.get(i, i + 1)], i in inside) for i in range(len(words)) if i not in within]
        least = max(1, int(np.ceil(coverage * len(words) - 1e-9)))
        numbered = [(np.array([index.number[w] for w in part], np.int32), group) for part, group in parts]
        diagonals = hopeful(numbers, np.array(diagonals), numbered, least).tolist()
        for d in diagonals:
            lo, hi = d - BAND, min(len(tokens), d + len(words) + BAND)
            own = [b""] * max(0, -lo) + tokens[max(0, lo) : hi]
            # once more up to where another copy may begin, so that a worn copy doesn't take words of the copy behind it
            for last in {hi, *(x for x in diagonals if d + coverage * len(words) <= x < hi)}:
                key = t, tuple(numbers[max(0, lo) : last].tolist()), lo if lo < 0 else 0
                if key not in known:
                    known[key] = best_part(parts, own[: last - lo], words, groups, coverage)
                if hits := known[key]:
                    first, final = lo + hits[0][1], lo + hits[-1][1]
                    found.setdefault(t, set()).add((len(hits) / len(words), int(at[starts[first]]), int(at[ends[final] - 1]) + 1))
    out = []
    for t, matches in found.items():
        kept: list[tuple[float, int, int]] = []
        for m in sorted(matches, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(m[2] <= k[1] or m[1] >= k[2] for k in kept):
                kept.append(m)
        out += [(index.names[t], *m) for m in kept]
    return sorted(out, key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: (id, license, coverage, start_byte, end_byte, matched)."""
    index = Index(TEMPLATES if templates is None else templates)

    def run(b: pa.RecordBatch):
        rows = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(key, *m, raw[m[2] : m[3]].decode("utf-8", "replace")) for m in scan_text(raw, index, coverage)]
        if rows:
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "license", "coverage", "start_byte", "end_byte", "matched"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` bigint, license string, coverage double, start_byte bigint, end_byte bigint, matched string")
