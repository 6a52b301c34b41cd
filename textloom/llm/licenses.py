"""License scans by conditional compression.

Candidate blocks are compressed with each template as zstandard raw dictionary, and templates
rank by the bytes that they save.  From the first on, each is confirmed by exact wording:
words are aligned, and the template wins if nearly all its words are there in order and no
word that tells licences apart (names, versions) differs.  The winner's words are taken out
and what stands before and after them is searched again, so a block may hold several notices.
A template is only tried where it saves ``LEAST_SAVED`` of its own compressed size.

Blocks are runs of lines that each hold a cue.  A run that no template explains is searched
again together with the lines around it, blank ones too, up to ``REACH`` words on both sides,
so notices that are wrapped or have several paragraphs are whole in one block; comment marks
at line starts don't count.  Blocks of over ``WINDOW`` words are cut into windows that
overlap by ``REACH`` words, so every notice is whole in one of them, however long the text.

The cue test runs in the JVM, so only candidate documents reach Python; the
scan is one map over the table, without a shuffle.

Defined results: null and empty texts have no blocks; documents without a
licence give a row with an empty list; equal reductions rank by template order;
rows are judged one by one, repeated ones too; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, table

CUE = r"(?i)licen[sc]|copyright|spdx-|permission is hereby|creative commons|\bCC BY\b|\bCC0\b|public domain|warrant(?:y|ies)|redistribution"
#: The same with cues that a line break and comment marks may part.
WRAPPED = CUE.replace(" ", r"[\s*#/;-]{1,40}")
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU_SHORT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_WORK = "This work is licensed under the GNU {name}, version {v}."
_GNU_NAMES = [("GPL-3.0", "General Public License", 3), ("GPL-2.0", "General Public License", 2), ("LGPL-3.0", "Lesser General Public License", 3), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("AGPL-3.0", "Affero General Public License", 3)]
#: Wordings of common licences and notices (fixed values), by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("MIT", _MIT_GRANT),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *[(spdx, _WORK.format(name=name, v=v)) for spdx, name, v in _GNU_NAMES],
    *[(spdx, text.format(name=name, v=v)) for spdx, name, v in _GNU_NAMES for text in (_GNU, _GNU_SHORT)],
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAME} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
KEY = {"mit", "apache", "gnu", "lesser", "affero", "mozilla", "bsd", "cc", "by", "nc", "sa", "nd", "cc0", "noncommercial", "attribution", "sharealike"}
LEAST_WORDS = 0.9
MOST_DIFFERING = 0.25
LEAST_SAVED = 0.4
TOKENS = re.compile(r"[^\W_]+(?:\.\d+)*")
LEADER = re.compile(r"^[\s*#/;%!>|-]+", re.M)


def words(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


REACH = max(len(words(t)) for _, t in TEMPLATES) * 5 // 4
WINDOW = 4 * REACH


def plain(text: str) -> str:
    """Lines without comment marks, joined."""
    return " ".join(LEADER.sub("", text).split())


class Matcher:
    """Compressors and words of the templates; one a process."""

    def __init__(self, templates=None):
        self.templates = TEMPLATES if templates is None else templates
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in self.templates]
        self.words = [words(t) for _, t in self.templates]
        self.size = [len(self.alone.compress(t.encode())) for _, t in self.templates]

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes of the compressed block that the template saves, template) from best to worst."""
        raw = block.encode()
        whole = len(self.alone.compress(raw))
        return sorted(((whole - len(c.compress(raw)), i) for i, c in enumerate(self.given)), key=lambda x: (-x[0], x[1]))

    def wording(self, own: list[str], i: int) -> tuple[list[str], int, int] | None:
        """The words that differ and the range of own words, if they hold template i's wording."""
        t = self.words[i]
        m = difflib.SequenceMatcher(None, t, own, autojunk=False).find_longest_match()
        spare = len(t) // 4
        low, high = max(0, m.b - m.a - spare), m.b - m.a + len(t) + spare
        ops = difflib.SequenceMatcher(None, t, own[low:high], autojunk=False).get_opcodes()
        same = [o for o in ops if o[0] == "equal"]
        if sum(o[2] - o[1] for o in same) < LEAST_WORDS * len(t):
            return None
        first, last = same[0][3], same[-1][4]
        diff = [w for o in ops if o[0] in ("delete", "replace") for w in t[o[1] : o[2]]]
        diff += ["+" + w for o in ops if o[0] in ("insert", "replace") and o[3] >= first and o[4] <= last for w in own[low + o[3] : low + o[4]]]
        if len(diff) > MOST_DIFFERING * len(t) or any(w.lstrip("+") in KEY or w.lstrip("+")[:1].isdigit() for w in diff):
            return None
        return diff, low + first, low + last

    def matches(self, block: str) -> list[tuple[str, float, list[str]]]:
        """(licence, share of the compressed block that it saves, words that differ) of each notice of a block."""
        at = list(TOKENS.finditer(block))
        own = [m[0].lower() for m in at]
        if not own:
            return []
        whole = len(self.alone.compress(block.encode()))
        for saved, i in self.ranked(block):
            if saved <= 0:
                break
            if saved >= LEAST_SAVED * self.size[i] and (found := self.wording(own, i)):
                diff, first, last = found
                return [*self.matches(block[: at[first].start()]), (self.templates[i][0], saved / whole, diff), *self.matches(block[at[last - 1].end() :])]
        return []


_MATCHER: list[Matcher] = []


def windows(block: str) -> list[str]:
    """A block, or if it is long, windows of it that overlap by REACH words."""
    at = [m.start() for m in TOKENS.finditer(block)]
    if len(at) <= WINDOW:
        return [block]
    step = WINDOW - REACH
    return [block[at[i] : at[i + WINDOW] if i + WINDOW < len(at) else len(block)] for i in range(0, max(1, len(at) - REACH), step)]


def runs(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines, and ranges of neighbouring ones that hold a cue, which may be parted by a line break."""
    rows = text.split("\n")
    cue, starts = [False] * len(rows), [0]
    for x in rows:
        starts.append(starts[-1] + len(x) + 1)
    for m in re.finditer(WRAPPED, text):
        for k in range(bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_right(starts, m.end() - 1)):
            cue[k] = True
    edge = [i for i in range(len(rows) + 1) if (i < len(rows) and cue[i]) != (i > 0 and cue[i - 1])]
    return rows, list(zip(edge[::2], edge[1::2]))


def around(rows: list[str], low: int, high: int) -> tuple[int, int]:
    """The range with whole lines of REACH words on both sides, as far as there are."""
    n = 0
    while low and n < REACH:
        low -= 1
        n += len(words(rows[low]))
    n = 0
    while high < len(rows) and n < REACH:
        n += len(words(rows[high]))
        high += 1
    return low, high


def notices(text: str, find) -> tuple[int, list[tuple[str, float, list[str]]]]:
    """The number of cue runs and the notices found; find(block) searches a block."""
    rows, found = runs(text)
    search = lambda low, high: [m for w in windows(plain("\n".join(rows[low:high]))) for m in find(w)]
    hits = [(low, high, search(low, high)) for low, high in found]
    wide: list[tuple[int, int]] = []
    for low, high, own in hits:
        if not own:
            low, high = around(rows, low, high)
            if wide and low <= wide[-1][1]:
                low = wide.pop()[0]
            wide.append((low, high))
    # A wide block is searched as a whole, and says what the runs in it are.
    out = [h for h in hits if not any(low <= h[0] and h[1] <= high for low, high in wide)] + [(low, high, search(low, high)) for low, high in wide]
    return len(found), [m for _, _, own in sorted(out, key=lambda h: h[:2]) for m in own]


def _scan(batches):
    if not _MATCHER:
        _MATCHER.append(Matcher())
    known: dict[str, list] = {}

    def find(block: str) -> list:
        if block not in known:
            if len(known) > 10_000:
                known.clear()
            known[block] = _MATCHER[0].matches(block)
        return known[block]

    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n, hits = notices(text or "", find)
            out.append((doc, n, ",".join(dict.fromkeys(m[0] for m in hits)), round(max([m[1] for m in hits], default=0.0), 6), ",".join(dict.fromkeys(w for m in hits for w in m[2]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()))], ["doc_id", "n_blocks", "licenses", "best_reduction", "differing_words"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, licenses, best_reduction, differing_words of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cue = F.coalesce(F.col("text").rlike(WRAPPED), F.lit(False))
    none = rows.where(~cue).select("doc_id", F.lit(0).cast("long").alias("n_blocks"), F.lit("").alias("licenses"), F.lit(0.0).alias("best_reduction"), F.lit("").alias("differing_words"))
    return rows.where(cue).mapInArrow(_scan, "doc_id long, n_blocks long, licenses string, best_reduction double, differing_words string").unionByName(none)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
