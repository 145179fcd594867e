"""Licence scans: texts compared with licence templates by Dice's coefficient over word bigrams.

A text is normalised to its lower-cased words of letters and digits. Units are
the whole text, each line, and windows of consecutive lines: one for each
template and each line that has a bigram of it, from that line to the end of the
line in which as many words as the template's are reached. With a and b the
numbers of distinct bigrams of a unit and a template, a coefficient of t needs
t / (2 - t) * b <= a <= (2 - t) / t * b; no unit is compared with a template
outside these bounds. The smallest unit within the bounds shares t * (a + b) / 2
bigrams with the template, so of any other choice of more than b less that number
it has at least one: a text without a single word of such a choice is passed over
unread.

A text is compared in its own row, so nothing is shuffled, and rows that repeat a
doc_id, or have none, have findings of their own. Nulls and empties: null and
empty texts and units of fewer than two words have no licence. Further columns
are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence notices and texts, as published, without their copyright lines. Fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def bigrams(own: Column) -> Column:
    """Distinct hashes of the bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.size(own)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))


def _bounds(size: int, least: float) -> tuple[int, int]:
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def template_array(spark: SparkSession, templates: dict[str, str], least: float) -> Column:
    """The templates as one constant: an array of (license, n_words, grams, low, high). Their number is a parameter."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string").select("license", words(F.col("body")).alias("w")).select("license", F.size("w").alias("n"), bigrams(F.col("w")).alias("grams")).collect()
    one = lambda r: F.struct(
        F.lit(r["license"]).alias("license"), F.lit(r["n"]).alias("n_words"), F.split(F.lit(",".join(map(str, r["grams"]))), ",").cast("array<bigint>").alias("grams"),
        *[F.lit(x).alias(k) for k, x in zip(("low", "high"), _bounds(len(r["grams"]), least), strict=True)],
    )
    return F.array(*[one(r) for r in rows if r["grams"]])


def telltales(templates: dict[str, str], least: float) -> str:
    """A pattern that every text near enough to a template has: words that cover enough of each template's bigrams, the longer the better."""
    chosen: set[str] = set()
    for body in templates.values():
        own = re.findall(r"[^\W_]+", body.lower())
        pairs = set(zip(own, own[1:], strict=False))
        low = _bounds(len(pairs), least)[0]
        enough = len(pairs) - math.ceil(least * (low + len(pairs)) / 2 - 1e-9) + 1
        while pairs and sum(bool(chosen & set(x)) for x in pairs) < enough:
            left = [x for x in pairs if not chosen & set(x)]
            gain = {w: sum(w in x for x in left) * len(w) ** 2 for x in left for w in x}
            chosen.add(max(gain, key=lambda w: (gain[w], w)))
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(map(re.escape, chosen))) + r")(?![\p{L}\p{N}])"


def found_in(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """docs with ``found``: an array of (order, license, line, last, dice) of each unit that is near enough to a template, or null."""
    known = template_array(docs.sparkSession, templates, least)
    held = "struct<line:int,words:array<string>,grams:array<bigint>>"
    # a text without a telltale is null from here on, and costs nothing
    rows = docs.withColumn("_text", F.when(F.col("text").rlike(telltales(templates, least)), F.col("text")))
    lines = F.transform(F.split("_text", "\n"), lambda x, k: F.struct((k + 1).alias("line"), words(x).alias("words")))
    rows = rows.withColumn("_lines", F.filter(lines, lambda x: F.size(x["words"]) > 0))
    rows = rows.withColumn("_lines", F.transform("_lines", lambda x: F.struct(x["line"], x["words"], bigrams(x["words"]).alias("grams")).cast(held)))
    rows = rows.withColumn("_words", F.flatten(F.transform("_lines", lambda x: x["words"])))
    # for each word the place of its line, for each line the place of its first word
    rows = rows.withColumn("_of", F.flatten(F.transform("_lines", lambda x, j: F.transform(x["words"], lambda w: j))))
    n = F.size("_words")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_starts", F.filter(places, lambda k: (k == 0) | (F.get("_of", k) != F.get("_of", k - 1))))

    def near(grams: Column, t: Column, line: Column, last: Column) -> Column:
        a, b = F.size(grams), F.size(t["grams"])
        dice = 2 * F.size(F.array_intersect(grams, t["grams"])) / (a + b)
        return F.struct((-dice).alias("order"), t["license"].alias("license"), line.cast("int").alias("line"), last.cast("int").alias("last"), dice.alias("dice"))

    fits = lambda grams: lambda t: F.size(grams).between(t["low"], t["high"])

    def window(x: Column, j: Column, t: Column) -> Column:
        """The lines from x on until the template's number of words; null where that is one line."""
        end = F.get("_of", F.least(F.get("_starts", j) + t["n_words"], n) - 1)
        stop = F.coalesce(F.get("_starts", end + 1), n)
        own = F.when((end > j) & F.arrays_overlap(x["grams"], t["grams"]), F.slice("_words", F.get("_starts", j) + 1, F.greatest(stop - F.get("_starts", j), F.lit(0))))
        return F.struct(t.alias("t"), x["line"].alias("line"), F.get("_lines", end)["line"].alias("last"), bigrams(own).alias("grams"))

    each_line = F.flatten(F.transform("_lines", lambda x: F.transform(F.filter(known, fits(x["grams"])), lambda t: near(x["grams"], t, x["line"], x["line"]))))
    windows = F.flatten(F.transform("_lines", lambda x, j: F.transform(known, lambda t: window(x, j, t))))
    windows = F.filter(windows, lambda u: u["grams"].isNotNull() & F.size(u["grams"]).between(u["t"]["low"], u["t"]["high"]))
    over_lines = F.transform(windows, lambda u: near(u["grams"], u["t"], u["line"], u["last"]))
    rows = rows.withColumn("_all", bigrams(F.col("_words")))
    whole = F.transform(F.filter(known, fits(F.col("_all"))), lambda t: near(F.col("_all"), t, F.lit(0), F.lit(0)))
    found = F.filter(F.concat(whole, each_line, over_lines), lambda x: x["dice"] >= least - 1e-9)
    return rows.select(*docs.columns, found.alias("found"))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, line, last) of every unit that is near enough to a template; line 0 is the whole text."""
    found = found_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), templates, least)
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.license", "f.dice", "f.line", "f.last")


def best_license(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, dice, line, last) for each row of docs: the highest coefficient, then by licence and line; nulls where there is none."""
    found = found_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), templates, least)
    best = found.select("doc_id", F.array_min("found").alias("best"))
    return best.select("doc_id", "best.license", F.round("best.dice", 6).alias("dice"), F.col("best.line").cast("long").alias("line"), F.col("best.last").cast("long").alias("last"))
