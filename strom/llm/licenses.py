"""Licence notices by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: wording of published notices
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    # whole paragraphs, as they stand in files and licence texts
    "AGPL-3.0-paragraph": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-paragraph": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-limitation": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-source-condition": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary-condition": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0-paragraph": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-paragraph": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-paragraph": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0-paragraph": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-paragraph": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-inclusion": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-paragraph": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-paragraph": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes a set may have to reach ``least`` against one of ``n``: the Dice coefficient is at most 2 min / (a + b)."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def anchor_words(text: str, least: float) -> list[str]:
    """Words of which any passage reaching ``least`` has one.

    Such a passage shares ceil(n least / (2 - least)) of the n bigrams at least, so it shares one of any n + 1 less that
    many. The longest words are chosen until their bigrams are so many.
    """
    pairs = bigrams_of(text)
    enough = len(pairs) + 1 - size_bounds(len(pairs), least)[0]
    chosen, covered = [], set()
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(covered) >= enough:
            break
        chosen.append(word)
        covered |= {p for p in pairs if word in p.split()}
    return chosen


def _words(passage: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(passage, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.concat(a, F.lit(" "), b)))


def _matches(name: str, own: list[str], least: float) -> Column:
    """Bags of the row that match one notice."""
    low, high = size_bounds(len(own), least)

    def scored(bag: Column) -> Column:
        shared = F.size(F.array_intersect(bag, F.array(*map(F.lit, own))))
        return F.struct((2.0 * shared / (F.size(bag) + len(own))).alias("dice"), F.lit(name).alias("license"))

    fitting = F.filter("_bags", lambda bag: F.size(bag).between(low, high))
    return F.filter(F.transform(fitting, scored), lambda m: m["dice"] >= least - 1e-12)


def license_scan(docs: DataFrame, notices: Mapping[str, str] = NOTICES, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the licence notices among its lines and paragraphs (blocks between blank lines).

    A passage is reduced to lower-case ASCII words and matches a notice if 2 |A n B| / (|A| + |B|) over distinct word bigrams
    is ``least`` or more. Three tests come first, none of which can lose a match: the document contains one of the
    notices' anchor words, the passage does, and its number of bigrams lies within the notice's size bounds. Everything happens
    within the row: no shuffle, and a line repeated in millions of documents costs no more than any other.

    Columns: id, n_matches, best_license (highest Dice, then name; null if none), best_dice, licenses (distinct, sorted, by
    comma). Null and empty texts have none; rows that repeat an id are each judged; other columns are not read.
    """
    templates = sorted(notices.items())
    anchors = sorted({w for _, t in templates for w in anchor_words(t, least)})
    anchors = [w for w in anchors if not any(w != v and v in w for v in anchors)]  # a contained word finds the longer one as well
    folded = F.lower(F.col(text_column))
    likely = F.lit(False)
    for word in anchors:
        likely = likely | F.contains(folded, F.lit(word))
    passages = F.concat(F.split(text_column, "\n"), F.filter(F.split(text_column, r"\n[\x20\t\r]*\n"), lambda p: F.contains(p, F.lit("\n"))))

    def has_anchor(passage: Column) -> Column:
        return F.exists(F.array(*map(F.lit, anchors)), lambda w: F.contains(F.lower(passage), w))

    least_words = min(size_bounds(len(bigrams_of(t)), least)[0] for _, t in templates) + 1
    bags = F.transform(F.filter(passages, has_anchor), lambda p: _words(p))
    bags = F.transform(F.filter(bags, lambda w: F.size(w) >= least_words), _bigrams)
    found = [_matches(name, bigrams_of(text), least) for name, text in templates]
    none = F.expr("cast(array() as array<struct<dice:double,license:string>>)")
    rows = docs.select(F.col(id_column), F.when(likely, bags).alias("_bags"))
    rows = rows.select(id_column, F.when(F.col("_bags").isNotNull(), F.concat(*found)).otherwise(none).alias("_found"))
    best = F.element_at(F.array_sort(F.transform("_found", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license")))), 1)
    any_hit = F.size("_found") > 0
    return rows.select(
        id_column, F.size("_found").cast("bigint").alias("n_matches"), F.when(any_hit, best["license"]).alias("best_license"),
        F.when(any_hit, F.round(-best["d"], 6)).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_found", lambda m: m["license"]))), ",").alias("licenses"))
