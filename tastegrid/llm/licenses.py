"""License scans: MinHash bands over overlapping windows, verified by exact shingle containment.

A template of up to S words (S = 4, 8, 16, ... 512) is looked for in windows of 1.5 S words that begin
every S / 2 words, so that a passage of S words lies whole in one of them. Shingles have five words,
those of templates of under five words have three. A window that holds 0.8 or more of a template's
shingles has a Jaccard similarity with it of at least 0.1, so BANDS = 128 bands of one MinHash each miss
it with a probability under 0.9 ** 128 = 1.4e-6. Windows that share a band with a template are verified
by the exact share of its distinct shingles within the window. Two filters come first and lose nothing:
a document must hold one of the gate words (every template has a gate word in more than a fifth of its
shingles; the SQL has no gate), and a window one shingle of some template.

Words are runs of a-z and 0-9 in the lower-cased text. Defined cases: null and empty texts match
nothing; rows of one doc_id are one document, of its first match; documents without a match have no
row; other columns are ignored; a table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import let, table

SHINGLE, SHORT, BANDS, SHARE = 5, 3, 128, 0.8
SIZES = (4, 8, 16, 32, 64, 128, 256, 512)

# License texts and notices as they stand in documents.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "proprietary": "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
GATE = ("licens", "permission", "restriction", "software", "redistribut", "permitted", "reproduced", "publication", "reserved", "copyright", "liable", "warrant", "damage")


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def width_of(size: int) -> int:
    return SHORT if size == SIZES[0] else SHINGLE


def size_of(text: str) -> int:
    return next(s for s in SIZES if s >= len(words_of(text)))


def shingles_of(text: str) -> list[str]:
    w, n = words_of(text), width_of(size_of(text))
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def check_templates(templates: dict[str, str]) -> None:
    """Every template has a shingle, fits a window, and holds gate words in more than a fifth of its shingles."""
    for name, text in templates.items():
        if not SHORT <= len(words_of(text)) <= SIZES[-1]:
            raise ValueError(f"template {name} has fewer than {SHORT} or more than {SIZES[-1]} words")
        s = shingles_of(text)
        if sum(any(g in x for g in GATE) for x in s) <= (1 - SHARE) * len(s):
            raise ValueError(f"template {name} has gate words in too few of its shingles")


def _min_hashes(hashes: Column) -> Column:
    """BANDS MinHash values of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(k, h))))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, template, containment, word): each template found, its best window's share and first word."""
    templates = TEMPLATES if templates is None else templates
    check_templates(templates)
    spark = docs.sparkSession
    t = spark.createDataFrame([(n, size_of(x), shingles_of(x)) for n, x in templates.items()], "template string, size int, own array<string>")
    t = t.withColumn("own", F.transform("own", lambda s: F.xxhash64(s)))
    bands = t.select("template", "size", "own", F.posexplode(_min_hashes(F.col("own"))).alias("band", "value"))
    used = sorted({size_of(x) for x in templates.values()})
    widths = sorted({width_of(s) for s in used})
    known = {w: [r[0] for r in t.filter((F.col("size") == SIZES[0]) == (w == SHORT)).select(F.explode("own")).distinct().collect()] for w in widths}

    low = F.lower("text")
    gate = F.lit(False)
    for g in GATE:
        gate = gate | low.contains(g)

    def hashes(w: Column, n: int) -> Column:
        none = F.expr("CAST(array() AS array<bigint>)")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))).otherwise(none)

    def with_hits(n: int) -> Callable[[Column], Column]:
        at = lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(known[n]), i)), lambda i: i.isNotNull())
        return lambda h: F.struct(h.alias("h"), at(h).alias("hits"))

    def scan(w: Column) -> Column:
        return F.struct(*(let(hashes(w, n), with_hits(n)).alias(f"s{n}") for n in widths))

    d = docs.filter(gate).select(F.col("doc_id").cast("long"), let(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), scan).alias("s"))
    some = F.lit(False)
    for n in widths:
        some = some | (F.size(f"s.s{n}.hits") > 0)
    d = d.select("doc_id", F.explode(F.array("s")).alias("s")).filter(some).select("doc_id", "s.*")

    # every window of each size that holds a hit: the windows begin at i * S/2 and hold 1.5 S words
    def starts(s: int) -> Column:
        step, span = s // 2, s + s // 2 - width_of(s) + 1
        first = lambda p: F.greatest(F.ceil((p - (span - 1)) / step), F.lit(0))
        own = F.flatten(F.transform(f"s{width_of(s)}.hits", lambda p: F.sequence(first(p), F.floor(p / step))))
        return F.transform(F.array_distinct(own), lambda i: F.struct(F.lit(s).alias("size"), (i * step).cast("int").alias("word"), F.lit(span).alias("span")))

    h = F.col(f"s{widths[-1]}.h")
    for n in widths[:-1]:
        h = F.when(F.col("win.size") == SIZES[0], F.col(f"s{n}.h")).otherwise(h)
    win = d.select("doc_id", *(f"s{n}" for n in widths), F.explode(F.concat(*(starts(s) for s in used))).alias("win")).select("doc_id", "win.size", "win.word", F.slice(h, F.col("win.word") + 1, F.col("win.span")).alias("held"))
    probe = win.select("doc_id", "size", "word", "held", F.posexplode(let(F.col("held"), _min_hashes)).alias("band", "value"))
    met = probe.join(F.broadcast(bands), ["size", "band", "value"])  # a fixed list of templates
    share = F.size(F.array_intersect("own", "held")) / F.size("own")
    found = met.select("doc_id", "template", "word", share.alias("containment")).filter(F.col("containment") >= SHARE)
    best = found.groupBy("doc_id", "template").agg(F.max(F.struct("containment", -F.col("word"))).alias("m"))
    return best.select("doc_id", "template", F.round("m.containment", 6).alias("containment"), (-F.col("m.col2")).alias("word"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join(f"('{n}', {size_of(x)}, {width_of(size_of(x))}, {len(shingles_of(x))}, '{s}')" for n, x in TEMPLATES.items() for s in shingles_of(x))
    widths = ", ".join(map(str, sorted({width_of(size_of(x)) for x in TEMPLATES.values()})))
    return f"""
WITH t(template, size, width, n, shingle) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT doc_id, i AS pos, width, array_to_string(w[i + 1 : i + width], ' ') AS shingle FROM (SELECT doc_id, w, width, unnest(range(len(w) - width + 1)) AS i FROM w, (SELECT unnest([{widths}]) AS width))),
h AS (SELECT doc_id, pos, template, size, n, shingle, unnest(range(
        greatest(0, CAST(ceil((pos - (size + size // 2 - width)) / (size / 2.0)) AS BIGINT)), pos // (size // 2) + 1)) * (size // 2) AS word
      FROM s JOIN t USING (width, shingle)),
c AS (SELECT doc_id, template, word, count(DISTINCT shingle) / any_value(n) AS containment FROM h GROUP BY ALL HAVING count(DISTINCT shingle) / any_value(n) >= {SHARE}),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY containment DESC, word) AS k FROM c)
SELECT doc_id, template, round(containment, 6) AS containment, CAST(word AS INTEGER) AS word FROM b WHERE k = 1
"""


OP6_SQL = _sql()
