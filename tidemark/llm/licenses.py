"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A text is normalised to words (lower case, letters and digits only, "licence" as "license"), so line breaks, comment signs and
indents make no difference. A template of m bigrams is held against every stretch of m consecutive bigrams of the text: Dice = 2 *
common bigrams / (bigrams of both), counted with repetition. A text with fewer bigrams than that is held against it whole if its
size allows a Dice of t at all (at least m * t / (2 - t) bigrams, as common ones can't outnumber the smaller side); templates too
large for a text are pruned by this bound. Of findings that overlap, the one with most
common bigrams counts (then the higher Dice, then the first by name).

Only stretches that hold enough bigrams of the template are counted out: positions of template bigrams are marked over a whole slice
of texts at once, and a running sum of the marks is an upper bound of the common bigrams. Nothing is missed by that.

Row semantics: each row is scanned by itself, whole; null, empty or wordless texts hold no licence; a text or template of one word is
one bigram of that word alone. Repeated rows give repeated results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hashed, letter_words, mix, slices

LEAST = 0.8
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FSF = "GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_FSF_ONLY = "GNU {0} as published by the Free Software Foundation, version {1}."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the "
_GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the "
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the "
_HOPE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."


def _gnu(name: str, version: str, lead: str) -> list[str]:
    whole = lead + _FSF.format(name, version)
    return [whole, whole + _HOPE.format(name), lead + _FSF_ONLY.format(name, version), f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name} v{version}.", f"Released under the GNU {name}, version {version}."]


# The wording of public licences, their notices and short references to them.
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "AGPL-3.0": _gnu("Affero General Public License", "3", _GPL),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [f"{_BSD} 1. {_BSD_1} 2. {_BSD_2}", f"{_BSD} * {_BSD_1} * {_BSD_2}", "Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "BSD-3-Clause": [f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3}", f"{_BSD} * {_BSD_1} * {_BSD_2} * {_BSD_3}", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSD": [_BSD, "Released under the BSD License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": _gnu("General Public License", "2", _GPL_2),
    "GPL-3.0": _gnu("General Public License", "3", _GPL),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", _LGPL),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", _GPL),
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "WTFPL": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}


def normal_words(texts: pa.Array) -> pa.ListArray:
    return letter_words(pc.replace_substring(pc.utf8_lower(pc.fill_null(texts, "")), "licence", "license"))


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all bigrams in order, ends of each text's bigrams)."""
    h, ends = hashed(normal_words(texts))
    sizes = np.diff(ends, prepend=0)
    pair = mix(mix(h) * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], np.uint64(0)))
    last = ends[sizes > 0] - 1
    lone = np.zeros(len(h), bool)
    lone[ends[sizes == 1] - 1] = True
    keep = np.ones(len(h), bool)
    keep[last] = False
    keep |= lone
    pair[lone] = mix(h[lone])
    return pair[keep], np.cumsum(np.where(sizes == 1, 1, np.maximum(sizes - 1, 0)))


class Matcher:
    """The templates' bigrams, ordered by size."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST):
        self.least = least
        names = [name for name, texts in templates.items() for _ in texts]
        flat, ends = bigrams(pa.array([t for texts in templates.values() for t in texts], pa.string()))
        parts = np.split(flat, ends[:-1])
        self.templates = sorted(((len(p), name, Counter(p.tolist())) for name, p in zip(names, parts)), key=lambda x: x[:2])
        self.all = np.unique(flat)
        member = np.zeros((len(self.all), len(self.templates)), bool)
        for k, (_, _, c) in enumerate(self.templates):
            member[np.searchsorted(self.all, np.fromiter(c, np.uint64, len(c))), k] = True
        self.member = member

    @staticmethod
    def _common(grams: np.ndarray, own: Counter) -> int:
        return sum(min(n, own[g]) for g, n in Counter(grams.tolist()).items() if g in own)

    def _found(self, grams: np.ndarray, where: np.ndarray) -> list[tuple[float, int, str, int, int]]:
        """(-common, -dice, name, begin, end) of the stretches of one text that reach the least Dice; where: the place of each of its
        bigrams in ``all``, -1 for none."""
        out, t, n = [], self.least, len(grams)
        marked = np.flatnonzero(where >= 0)
        held = self.member[where[marked]]
        common = held.sum(0)
        for k, (m, name, own) in enumerate(self.templates):
            if n < m * t / (2 - t) - 1e-9:
                break  # this and all larger templates are too large for the text
            size = min(m, n)
            least = t * (size + m) / 2 - 1e-9
            if common[k] < least:
                continue
            sums = np.zeros(n + 1, np.int32)
            sums[marked[held[:, k]] + 1] = 1
            sums = np.cumsum(sums)
            for a in np.flatnonzero(sums[size:] - sums[: n - size + 1] >= least).tolist():
                c = self._common(grams[a : a + size], own)
                d = 2 * c / (size + m)
                if d >= t - 1e-12:
                    out.append((-c, -d, name, a, a + size))
        return out

    def scan(self, texts: pa.Array) -> list[dict[str, float]]:
        """For each text its licences, each with the best Dice of its findings."""
        flat, ends = bigrams(texts)
        at = np.minimum(np.searchsorted(self.all, flat), len(self.all) - 1)
        where = np.where(self.all[at] == flat, at, -1)
        some = np.add.reduceat(np.append(where >= 0, False), np.append(0, ends)[:-1]) * (np.diff(ends, prepend=0) > 0) if len(ends) else ends
        out = []
        for begin, end, hits in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), some.tolist()):
            got: dict[str, float] = {}
            taken: list[tuple[int, int]] = []
            for _, d, name, a, z in sorted(self._found(flat[begin:end], where[begin:end])) if hits else ():
                if all(z <= x or y <= a for x, y in taken):
                    taken.append((a, z))
                    got[name] = max(got.get(name, 0.0), -d)
            out.append(got)
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_licenses, licenses: names in order, joined by commas, dice: the best) of every row of docs (doc_id, text)."""

    def run(batches):
        m = Matcher(templates, least)
        for b in batches:
            for begin, end in slices(b.column(1)):
                part = b.slice(begin, end - begin)
                got = m.scan(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(g) for g in got], pa.int64()), pa.array([",".join(sorted(g)) for g in got]), pa.array([max(g.values(), default=0.0) for g in got], pa.float64())], names=["doc_id", "n_licenses", "licenses", "dice"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_licenses long, licenses string, dice double")
