"""License scans by conditional compression: blocks are ranked by what a template saves as a dictionary, and confirmed by wording."""

from __future__ import annotations

import bisect
import collections
import heapq
import itertools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public licence notices by identifier, short ones, headers and whole bodies.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU General Public License Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU General Public License Version 2, June 1991",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License Version 3, 29 June 2007",
    ),
    "LGPL-2.1": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU Affero General Public License Version 3, 19 November 2007",
    ),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("This work has been dedicated to the public domain under the CC0 1.0 Universal License.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Lower-case stems of the words that templates are looked for by, the rarest first.
STEMS = ("mozilla", "unencumbered", "domain", "reserved", "redistribut", "permission", "permit", "sublicen", "furnish", "merge", "restriction", "gnu", "foundation", "distribut", "copyright", "binary", "licen", "software", "warrant", "condition")
TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


class Notice(NamedTuple):
    line: int
    start: int
    length: int
    license: str
    differences: int
    saved: int


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def reading(template: Sequence[str], words: Sequence[str], most: int) -> tuple[int, int]:
    """Least number of words to insert, delete or replace so that some first words of ``words`` read as the template, and how many these are.

    Exact up to ``most``; anything above stands for more.
    """
    n = len(template)
    if list(words[:n]) == list(template):
        return 0, n
    words, never = words[: n + most], most + 1
    row = [min(j, never) for j in range(len(words) + 1)]
    for i, own in enumerate(template, 1):
        last, row = row, [never] * len(row)
        for j in range(max(0, i - most), min(len(words), i + most) + 1):
            cost = last[j] + 1
            if j:
                cost = min(cost, row[j - 1] + 1, last[j - 1] + (own != words[j - 1]))
            row[j] = min(cost, never)
        if min(row) > most:
            return never, 0
    cost = min(row)
    return cost, row.index(cost)


class Scanner:
    """Notices of a text, by conditional compression and then by exact wording differences.

    A template's candidates are blocks of words around its cues. Each block is compressed plainly and with the template as
    a raw dictionary, and candidates are ranked by how many bytes the dictionary saves. Those that save enough are confirmed: a stretch
    of the block must read as the template, up to ``tolerance`` of its words. Confirmed stretches are ranked by what their template
    saves of them, less LOSS bytes for each word that differs (so that none grows into its neighbour for the sake of like words), and
    each takes its words from all that come after it.

    No notice within the tolerance is missed. Up to d words of a template may differ, so one of any d + 1 of them is in the text
    as it is: each template has d + 1 cues, and the block of a cue holds whatever notice the cue may be part of. A block is
    passed over only if its dictionary saves less than a quarter (SPARED) of what it saves of the template itself: a tenth of
    changed words leaves runs of nine words on average, which the dictionary saves but for a few bytes a run. Templates of a few words, of which
    less than SURE bytes can be saved, are never passed over: what a block's other words take varies by some bytes.

    Numbers must be as they are in the template. So must the words in which it differs from another one, if they are so few that
    the tolerance would let a text of the other pass.
    """

    SPARED = 4
    SURE = 80
    LOSS = 8
    LEVEL = 3
    LEAST_BLOCK = 64

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, *, tolerance: float = 0.1) -> None:
        self.known = [(name, [w for w, _, _ in tokens(text)], self._packer(text)) for name, texts in templates.items() for text in texts]
        self.most = [int(tolerance * len(words)) for _, words, _ in self.known]
        self.plain = self._packer("")
        self.gain = [self.saving(k, " ".join(words).encode()) for k, (_, words, _) in enumerate(self.known)]
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for k, (_, words, _) in enumerate(self.known):
            rare = sorted(range(len(words)), key=lambda t: (next((i for i, s in enumerate(STEMS) if s in words[t]), len(STEMS)), -len(words[t])))
            for t in rare[: self.most[k] + 1]:
                self.anchors.setdefault(words[t], []).append((k, t))

        counts = [collections.Counter(words) for _, words, _ in self.known]
        self.needed: list[dict[str, int]] = []
        self.barred: list[dict[str, int]] = []
        for k, ((name, *_), own) in enumerate(zip(self.known, counts, strict=True)):
            needed, barred = {w for w in own if w[0].isdigit()}, set()
            for (other, *_), more in zip(self.known, counts, strict=True):
                here, there = own - more, more - own
                if name != other and max(here.total(), there.total()) <= self.most[k]:
                    needed |= set(here)
                    barred |= set(there)
            self.needed.append({w: own[w] for w in needed})
            self.barred.append({w: own[w] for w in barred})
        self.aligned = self.spared = 0

    def tells(self, k: int, words: list[str]) -> bool:
        """Whether these words have those that tell template ``k`` from its relatives."""
        return all(words.count(w) >= n for w, n in self.needed[k].items()) and all(words.count(w) <= n for w, n in self.barred[k].items())

    @classmethod
    def _packer(cls, text: str) -> zstandard.ZstdCompressor:
        words = " ".join(w for w, _, _ in tokens(text)).encode()
        raw = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
        if raw:
            raw.precompute_compress(level=cls.LEVEL)
        return zstandard.ZstdCompressor(level=cls.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)

    def saving(self, k: int, data: bytes, plain: int | None = None) -> int:
        """Bytes by which template ``k`` as a dictionary makes the data's compressed size smaller."""
        return (len(self.plain.compress(data)) if plain is None else plain) - len(self.known[k][2].compress(data))

    def around(self, words: list[str], p: int, k: int, t: int, low: int, high: int) -> tuple[int, int, int] | None:
        """Differences and stretch, within ``low`` and ``high``, of template ``k`` read with its word ``t`` at ``p``; None beyond the tolerance."""
        own, most = self.known[k][1], self.most[k]
        self.aligned += 1
        ahead, a = reading(own[:t][::-1], words[max(low, p - t - most) : p][::-1], most)
        if ahead > most:
            return None
        after, b = reading(own[t + 1 :], words[p + 1 : min(high, p + len(own) - t + most)], most - ahead)
        return (ahead + after, p - a, p + 1 + b) if ahead + after <= most and self.tells(k, words[p - a : p + 1 + b]) else None

    def candidates(self, words: list[str]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """(saved bytes, negative; template; first word; its cues as (word of the text, word of the template)) of each block, the largest reduction first."""
        blocks: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for p, word in enumerate(words):
            for k, t in self.anchors.get(word, ()):
                size, most = len(self.known[k][1]), self.most[k]
                step = max(self.LEAST_BLOCK, size)
                a = max(0, p - t - most) // step * step
                blocks.setdefault((k, a, min(len(words), a + step + size + 2 * most)), []).append((p, t))
        text = " ".join(words).encode()
        starts = [0, *itertools.accumulate(len(w.encode()) + 1 for w in words)]
        plain: dict[tuple[int, int], int] = {}
        found = []
        for (k, a, b), cues in blocks.items():
            data = text[starts[a] : starts[b] - 1]
            if (a, b) not in plain:
                plain[a, b] = len(self.plain.compress(data))
            saved = self.saving(k, data, plain[a, b])
            if self.gain[k] >= self.SURE and self.SPARED * saved < self.gain[k]:
                self.spared += len(cues)
            else:
                found.append((-saved, k, a, cues))
        return sorted(found)

    def __call__(self, text: str) -> list[Notice]:
        own = tokens(text)
        words = [w for w, _, _ in own]
        queue: list[tuple] = []

        def offer(p: int, k: int, t: int, low: int, high: int) -> None:
            if here := self.around(words, p, k, t, low, high):
                differ, a, b = here
                saved = self.saving(k, " ".join(words[a:b]).encode())
                heapq.heappush(queue, (self.LOSS * differ - saved, differ, a, b, saved, k, p, t))

        for _, k, _, cues in self.candidates(words):
            for p, t in cues:
                offer(p, k, t, 0, len(words))
        taken: list[tuple[int, int, Notice]] = []
        while queue:
            _, differ, a, b, saved, k, p, t = heapq.heappop(queue)
            i = bisect.bisect_right(taken, p, key=lambda n: n[0])
            low = taken[i - 1][1] if i else 0
            high = taken[i][0] if i < len(taken) else len(words)
            if p >= low and (a < low or b > high):  # reaches into a notice of a larger reduction: what is left beside that
                offer(p, k, t, low, high)
            elif p >= low:
                taken.insert(i, (a, b, Notice(text.count("\n", 0, own[a][1]), own[a][1], own[b - 1][2] - own[a][1], self.known[k][0], differ, saved)))
        return [n for *_, n in taken]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.1) -> DataFrame:
    """One row per notice: id, line (from 0), start, length (code points), license, differences (words), saved (bytes).

    Blocks around cues are compressed with each template as a raw zstandard dictionary and ranked by the bytes that saves; in that order
    they are confirmed if at most ``tolerance`` of the template's words differ, none of them a number or a word that tells its licence from a
    close relative. Of notices that overlap, the one of the largest reduction stays. Words are compressed and compared in lower case with
    a space between, so white space, line ends and comment marks don't hide a notice; cues are looked for in the JVM, so only texts
    that have one reach Python. A text of length n takes time in proportion to n and the number of templates whose cues it has.

    Null or empty text: no rows. Null ids pass through. Repeated rows: their notices repeat. A line
    with several notices yields all of them. Empty table: empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tolerance=tolerance)
        for batch in batches:
            found = [(i, n) for i, text in enumerate(batch.column(1).to_pylist()) for n in scanner(text)]
            columns = [pa.array([n[k] for _, n in found], pa.string() if k == 3 else pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *columns], names=["id", *Notice._fields])

    low = F.lower(text_col)
    cued = F.lit(False)
    stems = {next((s for s in STEMS if s in word), word) for word in Scanner(tolerance=tolerance).anchors}
    for cue in sorted(c for c in stems if not any(s != c and s in c for s in stems)):  # a word with a longer cue has the shorter one
        cued = cued | F.contains(low, F.lit(cue))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.where(cued).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, line long, start long, length long, license string, differences long, saved long").withColumnRenamed("id", id_col)
