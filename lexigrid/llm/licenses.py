"""License scans by conditional compression.

A candidate block is a run of text around a license cue. It is compressed on
its own and with each template as raw zstandard dictionary: the more of the
block a template holds, the smaller the result. Templates are ranked by that
reduction, measured by what they save on their own text; those that save less than half of it are no
candidates, and the others must be confirmed word by word.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.shipping import map_arrow

#: Public wording: the notices by which works are put under a license, and short licenses in full.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}

_CUES = ("licen[sc]e", "copyright", "rights reserved", "public domain", "permission is hereby granted", "permission to use copy", "permission is granted", "without warranty", "as is", "endorse or promote", "anyone is free", "redistribution and use", "free software", "source code form is subject", "creative commons", "waived all")
#: Between the words of a cue stands whatever may stand between words: line breaks, comment signs.
CUE = "|".join(c.replace(" ", r"[^\p{L}\p{N}]+") for c in _CUES)
AROUND = 8
SHORT = 24
#: Of what a template saves on its own text, the share that it must save on a block. A template within the tolerance keeps some three quarters.
LEAST_SHARE = 0.5
TOLERANCE = 0.1
_word = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")
_cue = regex.compile(CUE, regex.IGNORECASE)


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Words in lower case, with inner dots and hyphens, and where they stand."""
    return [(m.group().lower(), m.start(), m.end()) for m in _word.finditer(text)]


#: Literals stay as they are, so that sizes tell what was matched and not which letters are frequent.
_PLAIN = zstandard.ZstdCompressionParameters(window_log=17, chain_log=6, hash_log=13, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST)


class Templates:
    def __init__(self, texts: dict[str, str]) -> None:
        self.words = {k: [w for w, _, _ in word_spans(t)] for k, t in texts.items()}
        self.short = {k for k, w in self.words.items() if len(w) <= SHORT}
        self.longest = max(map(len, self.words.values()))
        self.alone = zstandard.ZstdCompressor(compression_params=_PLAIN)
        self.given, self.most = {}, {}
        for k, w in self.words.items():
            own = " ".join(w).encode()
            template = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[k] = zstandard.ZstdCompressor(compression_params=_PLAIN, dict_data=template)
            self.most[k] = len(self.alone.compress(own)) - len(self.given[k].compress(own))

    def ranked(self, block: list[str], short: bool) -> list[tuple[float, float, str]]:
        """``(share of what the template can save, share of the block's size saved, template)`` of the short or of the long templates, best first; ties by name.

        What saves less than ``LEAST_SHARE`` of what it can is no candidate: most of its wording is not there.
        """
        data = " ".join(block).encode()
        plain = len(self.alone.compress(data))
        out = []
        for k in self.words:
            if (k in self.short) == short:
                saved = plain - len(self.given[k].compress(data))
                if saved >= LEAST_SHARE * self.most[k]:
                    out.append((saved / self.most[k], saved / plain, k))
        return sorted(out, key=lambda x: (-x[0], x[2]))

    def confirm(self, block: list[str], name: str, tolerance: float = TOLERANCE) -> tuple[int, int, int, int] | None:
        """``(missing, extra, first, last)`` of the best place of the template in the block, or None beyond the tolerance.

        Missing words are the template's that the block lacks, extra ones the
        block's between the first and the last word in common. Their sum may be
        ``tolerance`` of the template's length, rounded down: short notices must match word for word.
        """
        want = self.words[name]
        most = int(tolerance * len(want))
        best = None
        if sum((Counter(want) & Counter(block)).values()) < len(want) - most:
            return None
        heads = set(want[: most + 1])
        for s in [i for i, w in enumerate(block) if w in heads]:
            part = block[s : s + len(want) + most]
            match = [m for m in SequenceMatcher(None, want, part, autojunk=False).get_matching_blocks() if m.size]
            if not match:
                continue
            common, last = sum(m.size for m in match), match[-1].b + match[-1].size
            found = len(want) - common, last - match[0].b - common, s + match[0].b, s + last
            if found[0] + found[1] <= most and (best is None or found[0] + found[1] < best[0] + best[1]):
                best = found
                if best[0] + best[1] == 0:
                    break
        return best

    def places(self, block: list[str], name: str, tolerance: float = TOLERANCE) -> Iterator[tuple[int, int, int, int]]:
        """Places of the template in the block that do not overlap, as ``confirm`` has them: the best one, and those before and behind it."""
        parts = [(0, len(block))]
        while parts:
            lo, hi = parts.pop()
            ok = self.confirm(block[lo:hi], name, tolerance)
            if ok is not None:
                missing, extra, first, last = ok[0], ok[1], lo + ok[2], lo + ok[3]
                yield missing, extra, first, last
                parts += [(lo, first), (last, hi)]


def blocks(spans: list[tuple[str, int, int]], text: str, reach: int) -> Iterator[tuple[int, int]]:
    """Word ranges around the cues, ``reach`` words to both sides; ranges that touch are one."""
    starts = [s for _, s, _ in spans]
    lo = hi = -1
    for m in _cue.finditer(text):
        w = max(0, bisect_right(starts, m.start()) - 1)
        a, b = max(0, w - reach), min(len(spans), w + reach)
        if a <= hi:
            hi = max(hi, b)
        else:
            if hi > lo:
                yield lo, hi
            lo, hi = a, b
    if hi > lo:
        yield lo, hi


def scan_text(text: str, t: Templates, tolerance: float = TOLERANCE) -> list[tuple[str, int, int, float, int, int]]:
    """``(license, start, stop, reduction, missing, extra)`` by start.

    Short templates are compared with narrow blocks and long ones with wide blocks. Of
    confirmed places that overlap, the one with the fewest differences stays; ties go to the
    longer template, then to the larger reduction, then to the name.
    """
    spans = word_spans(text)
    here = []
    for short in (True, False):
        for lo, hi in blocks(spans, text, (SHORT if short else t.longest) + AROUND):
            block = [w for w, _, _ in spans[lo:hi]]
            for _, saved, name in t.ranked(block, short):
                for missing, extra, first, last in t.places(block, name, tolerance):
                    here.append((missing + extra, -len(t.words[name]), -saved, name, lo + first, lo + last, missing, extra))
    taken: list[tuple[int, int]] = []
    found = []
    for _, _, saved, name, a, b, missing, extra in sorted(here):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            found.append((name, spans[a][1], spans[b - 1][2], round(-saved, 4), missing, extra))
    return sorted(found, key=lambda x: x[1])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, license, start, stop, reduction, missing, extra)``, one row for each confirmed notice.

    ``reduction`` is the share of the block's compressed size that the template saves,
    ``missing`` and ``extra`` the words in which the wording differs. Offsets
    count characters. Null and empty texts give no rows, nor does an empty table; repeated rows repeat, and a null ``doc_id``
    stays null. Ties between templates are settled as ``scan_text`` says. Texts of any length are scanned whole; time
    follows their length and the number of cues. Extra columns are not read.
    """
    texts = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(texts)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                out += [(doc_id, *f) for f in scan_text(text, t, tolerance)]
            cols = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["doc_id", "license", "start", "stop", "reduction", "missing", "extra"])

    rows = docs.where(F.col("text").rlike(f"(?i){CUE}")).selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    return map_arrow(rows, run, "doc_id long, license string, start int, stop int, reduction double, missing int, extra int")
