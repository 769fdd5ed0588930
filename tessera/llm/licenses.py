"""License scan by conditional compression.

Lines with a word of license language, and the few lines between two such lines, are
candidate blocks. A block is compressed alone and with each template as raw zstandard
dictionary; templates are ranked by the bytes they save, also where a long block leaves none. All are
then held against the block word by word, unless the words alone that the block lacks are too many edits: the stretch of the block with the fewest edits to the whole template is found, and
the winner has the smallest share of edits, at most ``MOST_EDITS`` and none at a word with a digit. A
confirmed stretch is cut out and the rest of the block is searched again, so that a block can hold several licenses.

Defined results: null and empty texts give no row; repeated rows give rows each; equal shares of edits
go to the better rank, then to the template's place in the list. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, steps, table, tidy

MOST_EDITS = 0.15
#: Lines without license language that a block may hold in a row.
GAP_LINES = 3
#: A block's words are searched in windows of so many, with half of it as overlap.
WINDOW_WORDS = 1200

# Wordings of public licenses and their usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    # the beginnings by which whole license texts are named
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("EPL-2.0", """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."""),
)

_TRIGGER = re.compile(r"licen[sc]e|copyright|rights\s+reserved|hereby\s+granted|redistribut|public\s+domain|creative\s+commons|sublicen|warrant|free\s+software|\bcc0?[ -]by\b|\bcc0\b", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


@functools.cache
def _library() -> list[tuple[str, list[str], object]]:
    """(name, words, compressor with the template as raw dictionary) of each template."""
    import zstandard as z

    out = []
    for name, text in TEMPLATES:
        words = [w.lower() for w in _WORD.findall(text)]
        raw = z.ZstdCompressionDict((" ".join(words) + " ").encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        out.append((name, words, z.ZstdCompressor(level=19, dict_data=raw, write_checksum=False, write_content_size=False)))
    return out


@functools.cache
def _alone() -> object:
    import zstandard as z

    return z.ZstdCompressor(level=19, write_checksum=False, write_content_size=False)


def fewest_edits(template: list[str], words: list[str]) -> tuple[int, int, int, list[str]]:
    """(edits, first, end, differences): the stretch of ``words`` nearest to the whole template, the earliest and then longest of equals."""
    n, m = len(template), len(words)
    cost = [[0] * (m + 1)]
    for i, t in enumerate(template, 1):
        above, row = cost[-1], [i]
        left = i
        for j, w in enumerate(words):
            d = above[j] + (t != w)
            if above[j + 1] < d:
                d = above[j + 1] + 1 if above[j + 1] + 1 < d else d
            if left + 1 < d:
                d = left + 1
            row.append(d)
            left = d
        cost.append(row)
    end = min(range(m + 1), key=lambda j: (cost[n][j], j))
    i, j, diff = n, end, []
    while i:
        here = cost[i][j]
        if j and here == cost[i - 1][j - 1] + (template[i - 1] != words[j - 1]):
            if template[i - 1] != words[j - 1]:
                diff.append(f"-{template[i - 1]}+{words[j - 1]}")
            i, j = i - 1, j - 1
        elif here == cost[i - 1][j] + 1:
            diff.append(f"-{template[i - 1]}")
            i -= 1
        else:
            diff.append(f"+{words[j - 1]}")
            j -= 1
    return cost[n][end], j, end, diff[::-1]


def best_license(words: list[str]) -> tuple[str, int, int, int, int, list[str]] | None:
    """(license, bytes saved, first word, end, edits, differences) of the confirmed winner over a stretch of words."""
    data = (" ".join(words) + " ").encode()
    plain = len(_alone().compress(data))
    ranked = sorted(((plain - len(c.compress(data)), -k) for k, (_, _, c) in enumerate(_library())), reverse=True)
    held = Counter(words)
    best = None
    for rank, (saved, k) in enumerate(ranked):
        name, template, _ = _library()[-k]
        # each word of the template that the block lacks is an edit at least
        if (Counter(template) - held).total() > MOST_EDITS * len(template):
            continue
        edits, a, b, diff = fewest_edits(template, words)
        if edits > MOST_EDITS * len(template) or any(any(c.isdigit() for c in d) for d in diff):
            continue
        got = (edits / len(template), -len(template), rank, (name, saved, a, b, edits, diff))
        if best is None or got[:3] < best[:3]:
            best = got
    return best and best[3]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of candidate blocks."""
    last = None
    for m in _TRIGGER.finditer(text):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        b = len(text) if b < 0 else b
        if last and (a <= last[1] or text.count("\n", last[1], a) <= GAP_LINES + 1):
            last = (last[0], max(last[1], b))
        else:
            if last:
                yield last
            last = (a, b)
    if last:
        yield last


def find_licenses(text: str) -> list[tuple[str, int, int, int, int, str]]:
    """(license, start, end, bytes saved, edits, differences) of all confirmed stretches, in text order; start and end count characters."""
    out = []
    for a, b in blocks(text):
        marks = [(m[0].lower(), a + m.start(), a + m.end()) for m in _WORD.finditer(text[a:b])]
        todo = [(0, len(marks))]
        while todo:
            lo, hi = todo.pop()
            for i in range(lo, hi, WINDOW_WORDS // 2):
                j = min(hi, i + WINDOW_WORDS)
                part = marks[i:j]
                if not _TRIGGER.search(text, part[0][1], part[-1][2]):
                    continue
                got = best_license([w for w, _, _ in part])
                if got:
                    name, saved, x, y, edits, diff = got
                    if y > x:
                        out.append((name, part[x][1], part[y - 1][2], saved, edits, " ".join(diff)))
                        todo += [(s, e) for s, e in ((i + y, hi), (lo, i + x)) if e > s]
                        break
                if j == hi:
                    break
    return sorted(out, key=lambda x: x[1:3])


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start, end_, saved_bytes, edits, differences and the matched text for each confirmed stretch."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "text"):
                rows = [(i, *f, t[f[1] : f[2]]) for i, t in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist()) for f in find_licenses(t)]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "start", "end_", "saved_bytes", "edits", "differences", "matched"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    return src.mapInArrow(tidy(scan), "doc_id long, license string, start long, end_ long, saved_bytes long, edits long, differences string, matched string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
