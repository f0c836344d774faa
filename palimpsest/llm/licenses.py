"""License scans by conditional compression.

A block reaches as many words to both sides of a license mark as the longest confirmed wording can
have, whatever the line ends; templates of like length share their blocks. A block is compressed
with zstandard alone, and with each template as a raw dictionary: templates are ranked by the bytes
they save, and each that saves a fair part of its own size is confirmed by the exact differences in
wording, the largest saving first. Of wordings that share words the most exact one stays.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from palimpsest.llm.common import documents

#: Notices by identifier: public wordings, fixed values. Several wordings of one license have an entry each.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]
#: Words of a mark may stand on two lines, with a comment's sign between them.
MARK = re.compile(r"licen[cs]|permission is hereby|permission to use|redistribut|all rights reserved|public domain|creative commons|\bcc by|\bcc0|warrant|waived|copyleft|do what the".replace(" ", "[^a-z0-9]+"), re.I)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*", re.I)
SCHEMA = "doc_id long, license string, start long, end long, saving double, similarity double, missing string, added string"
LEVEL = 9
#: A template saves at least so much of its own compressed size where a wording as like as 0.8 stands.
FAIR = 0.2
#: Words of the longest template whose blocks are short ones.
SHORT = 24
#: Blocks of more words than so many reaches are looked at in parts that overlap by two.
PART = 12


def blocks(text: str, starts: list[int], reach: int) -> list[tuple[int, int]]:
    """Ranges of words, `reach` to both sides of each license mark; ranges that meet are one. starts: where each word starts."""
    out: list[list[int]] = []
    for m in MARK.finditer(text):
        s = max(0, bisect.bisect_right(starts, m.start()) - 1 - reach)
        e = min(len(starts), bisect.bisect_left(starts, m.end()) + reach)
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _rows(item: np.ndarray, text: np.ndarray, cost: float) -> Iterator[np.ndarray]:
    """For each beginning of item: by end in text, the most matched words in order less `cost` for each text word put in between; words of item may be missing."""
    steps = np.arange(len(text) + 1) * cost
    row = np.zeros(len(text) + 1)
    for w in item:
        same = np.flatnonzero(text == w)
        if len(same):
            now = row.copy()
            now[same + 1] = np.maximum(now[same + 1], row[same] + 1)
            row = np.maximum.accumulate(now + steps) - steps
        yield row


def _trace(item: np.ndarray, text: np.ndarray, cost: float) -> list[tuple[int, int]]:
    """The matched words (of item, of text) of the best alignment."""
    rows = np.array([np.zeros(len(text) + 1), *_rows(item, text, cost)])
    i, j = len(item), int((rows[-1] > rows[-1].max() - 1e-6).argmax())
    out = []
    while i and rows[i, j] > 1e-6:
        if item[i - 1] == text[j - 1] and abs(rows[i, j] - rows[i - 1, j - 1] - 1) < 1e-6:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif abs(rows[i, j] - rows[i - 1, j]) < 1e-6:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], similarity: float, fair: float = FAIR):
        self.all, self.similarity = templates, similarity
        make = lambda **k: zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, **k).compress
        self.plain = make()
        self.words = [[w.lower() for w in WORD.findall(x)] for _, x in templates]
        plain = [" ".join(x).encode() for x in self.words]
        self.primed = [make(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if x else self.plain for x in plain]
        self.code: dict[str, int] = {}
        self.coded = [np.array([self.code.setdefault(w, len(self.code)) for w in x], np.int64) for x in self.words]
        #: a wording as like as `similarity` has at most so many words
        self.spans = [math.ceil(len(x) / similarity) for x in self.words]
        empty = len(self.plain(b""))
        self.size = [len(self.plain(x)) - empty for x in plain]
        self.fair = fair
        #: templates whose blocks have the same reach: short ones, long ones
        kinds = [[i for i, x in enumerate(self.words) if x and (len(x) <= SHORT) == short] for short in (True, False)]
        self.kinds = [(max(self.spans[i] for i in own), own) for own in kinds if own]

    def ranked(self, block: str, own: list[int]) -> list[tuple[int, int]]:
        """(bytes saved, template) of the templates that save a fair part of their size in a block, the largest saving first. Both are words in lower case with one space between them, so that line ends and comment signs cost nothing."""
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.plain(raw))
        saved = [(size - len(self.primed[i](raw)), i) for i in own]
        return sorted((x for x in saved if x[0] >= self.fair * self.size[x[1]]), key=lambda x: (-x[0], x[1]))

    def confirm(self, coded: np.ndarray, i: int) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """(likeness, matched words) of wordings of the template among coded words: words of the template in order, over all of them and those put in between.

        kept / (all + added) reaches the similarity where kept - similarity * added reaches similarity * all, so each such wording
        shows in one pass; then the cost is raised to the likeness found for as long as that finds one more like.
        """
        least = self.similarity * len(self.words[i]) - 1e-6
        row = np.zeros(len(coded) + 1)
        for row in _rows(self.coded[i], coded, self.similarity):
            pass
        over = np.r_[False, row >= least, False].astype(np.int8)
        edge = np.flatnonzero(np.diff(over))
        for s, e in zip(edge[::2], edge[1::2]):
            end = s + int((row[s:e] > row[s:e].max() - 1e-6).argmax())
            start = max(0, end - self.spans[i])
            like, same = -1.0, []
            now, cost = self.similarity, self.similarity
            while now > like + 1e-9:
                found = _trace(self.coded[i], coded[start:end], cost)
                if not found:
                    break
                now = len(found) / (len(self.words[i]) + found[-1][1] + 1 - found[0][1] - len(found))
                if now > like + 1e-9:
                    like, same, cost = now, [(a, start + b) for a, b in found], now
                else:
                    break
            if same and like >= self.similarity - 1e-9:
                yield like, same

    def find(self, text: str) -> Iterator[tuple]:
        """(template, start, end, saving, likeness, missing, added) of the licenses in a text. saving is a share of the template's own size."""
        if not MARK.search(text):
            return
        found = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
        starts = [s for s, *_ in found]
        coded = np.array([self.code.get(w, -1) for *_, w in found], np.int64)
        todo = [(s, e, reach, own) for reach, own in self.kinds for s, e in blocks(text, starts, reach)]
        hits: dict[tuple[int, int, int], tuple] = {}
        while todo:
            s, e, reach, own = todo.pop()
            if e - s > PART * reach:
                step = (PART - 2) * reach
                todo += [(a, min(e, a + PART * reach), reach, own) for a in range(s, e - 2 * reach, step)]
                continue
            for saved, i in self.ranked(" ".join(w for *_, w in found[s:e]), own):
                for like, same in self.confirm(coded[s:e], i):
                    a, z = s + same[0][1], s + same[-1][1] + 1
                    kept, inside = {x for x, _ in same}, {s + x for _, x in same}
                    missing = [w for k, w in enumerate(self.words[i]) if k not in kept]
                    added = [found[k][2] for k in range(a, z) if k not in inside]
                    # what the template saves of this wording alone
                    own_saving = self.ranked(" ".join(w for *_, w in found[a:z]), [i])
                    saving = own_saving[0][0] / max(1, self.size[i]) if own_saving else 0.0
                    if MARK.search(text, found[a][0], found[z - 1][1]):
                        hits[a, z, i] = (len(same) - len(missing) - len(added), like, saving, -i, a, z, missing, added)
        taken: list[tuple[int, int]] = []
        for _, like, saving, i, a, z, missing, added in sorted(hits.values(), key=lambda x: x[:6], reverse=True):
            at = bisect.bisect_left(taken, (a, z))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < z):
                continue
            taken.insert(at, (a, z))
            yield -i, found[a][0], found[z - 1][1], saving, like, " ".join(missing), " ".join(added)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, similarity: float = 0.8) -> DataFrame:
    """One row for each license found in each row of docs, as in SCHEMA; start and end are code points, end exclusive.

    Every wording as like a template as `similarity` is found, over line ends and whatever stands between its words, if a mark
    stands in it and the template saves at least FAIR of its own size in the block (tests/llm tries edited wordings down to that
    likeness). Of wordings that share words, the one with most of its template's words less the differences wins (ties: the more
    like, the larger saving, then the first template). missing and added are the differences in wording. Null and empty texts, and
    blocks without a confirmed template, give no row. Repeated rows give repeated results; other columns are ignored.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates, similarity)
        for pdf in batches:
            rows = [(doc, templates[i][0], *hit) for doc, text in zip(pdf["doc_id"], pdf["text"]) for i, *hit in known.find(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "start", "end", "saving", "similarity", "missing", "added"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents(docs).mapInPandas(run, SCHEMA)
