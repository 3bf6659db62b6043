"""Licence notices in texts: Dice coefficient over word bigrams, with size bounds.

A text is compared piece by piece: its sentences, lines and paragraphs, and the whole. A piece is
normalised to lower-case words of letters and digits. Two bags of n and m distinct bigrams have a
Dice coefficient of at most 2 min(n, m) / (n + m), so a piece only meets templates within a ratio
of sizes, and pieces beyond the sizes of all of them meet none. Sentences are also taken across
the lines of a paragraph, so a wrapped notice is one piece.

Licence texts and file headers are compared with windows of as many words, so they are found wrapped
and inside of longer texts. A window with a coefficient of c shares at least c / (2 - c) of the
template's bigrams, so texts with fewer have none. Of windows that overlap the most like one counts.

Everything is DataFrame functions; the templates are literals of the expression, nothing is shuffled
but the few matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import written

#: Common short notices by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    """The file header of a GNU licence."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        f"{name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Licence texts and file headers, compared with windows of as many words.
LONG_TEMPLATES = (
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    )),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License."
    )),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    )),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
)
#: What a window of a text is judged to be.
KIND = "array<struct<dice:double,start:int,end:int,order:int,license:string>>"
#: Least Dice coefficient of a match.
AT_LEAST = 0.8


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(value: Column, use) -> Column:
    """use(value), with value computed a single time: a lambda's variable is not evaluated again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(words: Column) -> Column:
    """All pairs of neighbours in order; the word itself for a single one."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(words)


def _bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours; the word itself for a single one."""
    return F.array_distinct(_pairs(words))


def template_bigrams(text: str) -> list[str]:
    """The same normalisation for the templates, which are plain ASCII."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:]))) or words


def telling_words(gram: list[str], needed: float) -> list[str]:
    """Long words of a template such that fewer pairs than needed are without any of them: a text that reaches the number holds one."""
    chosen: list[str] = []
    for word in sorted({w for pair in gram for w in pair.split()}, key=lambda w: (-len(w), w)):
        if sum(not set(pair.split()) & set(chosen) for pair in gram) < needed:
            break
        chosen.append(word)
    return chosen


def _windows(rows: DataFrame, templates, at_least: float) -> DataFrame:
    """(doc_id, row, text) -> (doc_id, row, license, dice): the windows of template size that are most like one."""
    grams = [template_bigrams(text) for _, text in templates]
    lengths = [len("".join(c.lower() if c.isalnum() else " " for c in text).split()) - 1 for _, text in templates]
    literal = [F.array(*[F.lit(x) for x in gram]) for gram in grams]
    needed = [at_least / (2 - at_least) * len(gram) - 1e-6 for gram in grams]
    every = F.array(*[F.lit(x) for x in dict.fromkeys(x for gram in grams for x in gram)])
    pairs = rows.select("doc_id", "row", _once(words_of(F.col("text")), _pairs).alias("pairs")).where(F.size("pairs") >= min(needed))
    known = pairs.withColumn("known", F.array_intersect("pairs", every)).where(F.size("known") >= min(needed))

    def best(k: int) -> Column:
        def window(at: Column) -> Column:
            def judged(own: Column) -> Column:
                dice = 2 * F.size(F.array_intersect(own, literal[k])) / (F.size(own) + len(grams[k]))
                return F.struct(dice.alias("dice"), (-at).alias("start"), (at + lengths[k] - 1).alias("end"), F.lit(-k).alias("order"), F.lit(templates[k][0]).alias("license"))

            return _once(F.array_distinct(F.slice("pairs", at, F.lit(lengths[k]))), judged)

        places = F.transform("pairs", lambda x, i: F.when(F.array_contains(literal[k], x), i + 1))
        starts = F.filter(places, lambda at: at.isNotNull())  # a window that begins elsewhere is no better
        enough = F.size(F.array_intersect("known", literal[k])) >= needed[k]
        return F.when(enough, F.filter(F.transform(starts, window), lambda x: x["dice"] >= at_least)).otherwise(F.array().cast(KIND))

    found = known.select("doc_id", "row", F.flatten(F.array(*[best(k) for k in range(len(templates))])).alias("all"))
    # Of each licence's windows at one place and of overlapping ones of other licences only the best stays.
    beaten = lambda x: F.exists("all", lambda y: (y > x) & (-y["start"] <= x["end"]) & (-x["start"] <= y["end"]))
    found = found.where(F.size("all") > 0).select("doc_id", "row", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x"))
    return found.select("doc_id", "row", F.col("x.license").alias("license"), F.col("x.dice").alias("dice"))


def notices(
    docs: DataFrame, templates=TEMPLATES, at_least: float = AT_LEAST, id_col: str = "doc_id", text_col: str = "text",
    long_templates=LONG_TEMPLATES,
) -> DataFrame:
    """(doc_id, license, dice, n_pieces): per row of docs and licence found, the best coefficient and the number of
    different pieces and windows that match one of its templates.

    A piece counts for the template that it is most like, for the first of the list among equals.
    Defined cases: null and empty texts, and rows without a match, give no rows; a null id is
    returned as null; repeated rows give repeated results; an empty table gives no rows. Other
    columns are not read. Texts are scanned whole.
    """
    grams = [template_bigrams(text) for _, text in templates]
    low, high = at_least / (2 - at_least), (2 - at_least) / at_least
    fewest, most = min(map(len, grams)) * low, max(map(len, grams)) * high + 1  # a piece of m words has at most m - 1 bigrams
    text = F.regexp_replace(F.col(text_col), "\r\n?", "\n")

    def pieces(x: Column) -> Column:
        lines = F.split(x, "\n")
        paragraphs = F.split(x, r"\n\s*\n")
        sentences = F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.!?:;])\s+")))
        joined = F.flatten(F.transform(F.filter(paragraphs, lambda y: F.instr(y, "\n") > 0), lambda y: F.split(y, r"(?<=[.!?:;])\s+")))
        return F.array_union(F.array_union(sentences, lines), F.array_union(F.array_union(paragraphs, joined), F.array(x)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    # Only texts that hold a telling word of some template are taken apart; they are written, so both ways see the same rows.
    every = [(template_bigrams(x), low) for _, x in [*templates, *long_templates]]
    telling = dict.fromkeys(word for gram, share in every for word in telling_words(gram, share * len(gram) - 1e-6))
    texts = written(texts.where(F.arrays_overlap(words_of(F.col("text")), F.array(*[F.lit(x) for x in telling]).cast("array<string>"))), "telling-texts")
    rows = texts.select("doc_id", "row", F.explode(_once(F.col("text"), pieces)).alias("piece"))
    rows = rows.where(F.length("piece") > 0)

    def dice(own: Column, gram: list[str]) -> Column:
        n = F.size(own)
        shared = F.size(F.array_intersect(own, F.array(*[F.lit(x) for x in gram])))
        return F.coalesce(F.when(n.between(len(gram) * low, len(gram) * high), 2 * shared / (n + len(gram))), F.lit(0.0))

    def best(own: Column) -> Column:
        found = F.array(*[
            F.struct(dice(own, gram).alias("dice"), F.lit(-k).alias("order"), F.lit(name).alias("license"))
            for k, ((name, _), gram) in enumerate(zip(templates, grams))
        ])
        return F.when(F.size(own).between(fewest, most), F.array_max(found))

    found = rows.select("doc_id", "row", _once(_once(words_of(F.col("piece")), _bigrams), best).alias("x")).where(F.col("x.dice") >= at_least)
    found = found.select("doc_id", "row", F.col("x.license").alias("license"), F.col("x.dice").alias("dice"))
    if long_templates:
        found = found.unionByName(_windows(texts, long_templates, at_least))
    return found.groupBy("doc_id", "row", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_pieces")).drop("row")
