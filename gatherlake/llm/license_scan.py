"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is parted at line breaks and after the ends of sentences; what is compared with a template
is any run of consecutive parts, so a notice is found as a line, wrapped over lines, behind comment
marks or inside a paragraph. A template is a candidate only where enough of its bigrams occur, and
a run only while its size could still reach the least coefficient.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"\n|(?<=[.!?;:])[^\S\n]+")
#: Lines that name a holder, not a licence; templates and texts are compared without them.
_COPYRIGHT = re.compile(r"^\W*(copyright\s+(\(c\)|©|\d{4})|\(c\)\s*\d{4}|©).*$", re.IGNORECASE | re.MULTILINE)

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_GNU = (
    "This {work} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of "
    "the License, or (at your option) any later version.\nThis {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)
#: Licences and notices as publicly stated. A folder of texts may replace or extend them, see :func:`read_templates`.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _CLAUSES + _DISCLAIMER,
    "BSD-3-Clause": _CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _DISCLAIMER,
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-opening": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": _GNU.format(work="program", colon=";", kind="", v="2"),
    "GPL-3.0": _GNU.format(work="program", colon=":", kind="", v="3"),
    "LGPL-2.1": _GNU.format(work="library", colon=";", kind="Lesser ", v="2.1"),
    "AGPL-3.0": _GNU.format(work="program", colon=":", kind="Affero ", v="3"),
    "GPL-3.0-opening": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-short": "Released under the MIT License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
}


def normal_words(text: str) -> list[str]:
    """Lower-case letters and digits; everything else parts words."""
    return _WORD.findall(text.lower())


def parts_of(text: str) -> list[tuple[int, list[str]]]:
    """Line number and words of each part of a text that has words, without lines of copyright."""
    out, line, at = [], 0, 0
    text = _COPYRIGHT.sub("", text)
    for m in [*_PART.finditer(text), None]:
        words = normal_words(text[at : m.start() if m else len(text)])
        if words:
            out.append((line, words))
        if m:
            at, line = m.end(), line + (m[0] == "\n")
    return out


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def template_bigrams(text: str) -> Counter:
    return bigrams([w for _, words in parts_of(text) for w in words])


def read_templates(folder: str) -> dict[str, str]:
    """Templates from a folder of the driver: one .txt file each, named as the licence is."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


def _scan(templates: dict[str, str], least: float):
    known = {name: template_bigrams(t) for name, t in templates.items()}
    sizes = {name: grams.total() for name, grams in known.items()}
    # a coefficient of least needs so many bigrams in common, and a run that isn't larger than this
    need = {name: least * n / (2 - least) - 1e-9 for name, n in sizes.items()}
    most = {name: n * (2 - least) / least + 1e-9 for name, n in sizes.items()}
    first: dict[tuple, list[str]] = {}
    for name, grams in known.items():
        for g in grams:
            first.setdefault(g, []).append(name)

    def open_starts(name: str, places: list[int], words: list[str], edges: list[int], starts: list[int]) -> list[int]:
        """The starts from which a run could have enough in common: bigrams of the longest run that begins there,
        each counted as often as the template has it, are kept while the window moves over the text."""
        grams, inside, total, lo, hi, out = known[name], Counter(), 0, 0, 0, []
        for i in starts:
            while hi < len(places) and places[hi] - edges[i] + 1 <= most[name]:
                g = (words[places[hi]], words[places[hi] + 1])
                inside[g] += 1
                total += inside[g] <= grams[g]
                hi += 1
            while lo < hi and places[lo] < edges[i]:
                g = (words[places[lo]], words[places[lo] + 1])
                total -= inside[g] <= grams[g]
                inside[g] -= 1
                lo += 1
            if total >= need[name]:
                out.append(i)
        return out

    def runs(name: str, words: list[str], edges: list[int], starts: list[int]):
        """Runs of parts that reach ``least``: bigrams in common, coefficient, first and last part."""
        for i in starts:
            left, both, at = dict(known[name]), 0, edges[i]
            for j in range(i, len(edges) - 1):
                if edges[j + 1] - edges[i] - 1 > most[name]:
                    break
                while at < edges[j + 1] - 1:
                    g = (words[at], words[at + 1])
                    if left.get(g, 0):
                        left[g] -= 1
                        both += 1
                    at += 1
                score = 2 * both / (edges[j + 1] - edges[i] - 1 + sizes[name])
                if score >= least:
                    yield both, score, i, j

    def best(text: str | None) -> list[dict]:
        parts = parts_of(text or "")
        words = [w for _, part in parts for w in part]
        hits: dict[str, list[int]] = {}
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            for name in first.get(g, ()):
                hits.setdefault(name, []).append(i)
        hits = {name: places for name, places in hits.items() if len(places) >= need[name]}
        if not hits:
            return []
        edges, homes = [0], []
        for n, (_, part) in enumerate(parts):
            edges.append(edges[-1] + len(part))
            homes += [n] * len(part)
        found = [(-both, -score, i, j, name) for name, places in hits.items() for both, score, i, j in runs(name, words, edges, open_starts(name, places, words, edges, sorted({homes[p] for p in places})))]
        # the run with most in common first; what overlaps it, of any licence, goes
        out, taken = [], set()
        for _, score, i, j, name in sorted(found):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                out.append({"license": name, "line": parts[i][0], "last_line": parts[j][0], "dice": -score})
        return sorted(out, key=lambda x: (x["line"], x["last_line"], x["license"]))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("last_line", pa.int64()), ("dice", pa.float64())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for s in range(0, max(len(texts), 1), 512):
                part = batch.slice(s, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([best(t) for t in part.column(part.num_columns - 1).to_pylist()], kind)], names=[*part.schema.names[:-1], "licenses"])

    return run


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id and licenses (array of license, line, last_line, dice; lines from 0) of every document.

    Every run of consecutive parts (see the module) of which the bigrams reach ``least`` with a
    template is found; of runs that overlap the one with most bigrams in common stays (so a full licence, not its
    opening), then the best, then the one that begins first, then the shortest, then by name. The number of templates is fixed, whatever the corpus. A template
    of one word has no bigrams and is never found. Null and empty texts have none; one row comes
    out for each that goes in, whatever its doc_id; other columns are not read; an empty table
    gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(templates or TEMPLATES, least), f"doc_id {kind}, licenses array<struct<license: string, line: bigint, last_line: bigint, dice: double>>")


def license_digest(found: DataFrame) -> DataFrame:
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), names.alias("licenses"))
