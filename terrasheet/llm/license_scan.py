"""Licence notices, with DataFrame functions only: normalised text against templates by Dice over word bigrams.

A text's segments are its distinct lines, the text as a whole, and, for each template, all windows of as many words as it has,
one beginning at every word: a notice that is wrapped over lines, or stands within a line, is seen whole wherever it is.
Segments and templates become lower-case words of letters and digits, and the set of their word bigrams. The Dice coefficient
of sets of a and b bigrams is at most 2 * min(a, b) / (a + b), so a template is compared only with segments whose size can
reach the threshold; segments that share no bigram with any template are left out first, and so are the windows of a template
of which the text hasn't as many bigrams as any window would need. First of all, a text must hold one of a few words: so
many of a template's bigrams have one of them that no segment can reach it without. Templates are literals of the plan: a
list of notices, not data.

Windows aren't built. A bigram's occurrence counts in the windows that hold it and not the one before it, a range of
beginnings; sums over where these ranges begin and end give the bigrams of every window, and those of the template among
them, in time proportional to the text. This is done once for equal texts, behind one shuffle of the texts that hold enough
of a template; everything else is one pass without a shuffle but for the join of both by the text's digest.

Null and empty texts, and texts of one word, have no segments with bigrams. Repeated rows have equal results; very long texts
are treated whole, in a task's memory. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices, headers and bodies by SPDX-like id.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words that are looked for last, as ordinary texts are full of them.
COMMON = set("a all and any are as at be by can code copy distributed file following for found free from general general in is it law may not of on one or other person public source terms that the this to under use version with work you 0 1 2 3 4".split())
#: Least Dice coefficient of a match, in hundredths.
THRESHOLD = 80
#: What separates words.
BREAK = r"[^a-z0-9\x80-\x{10FFFF}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed(n: int, threshold: int) -> int:
    """Bigrams that a segment must share with a template of n to reach the threshold."""
    return -(-n * threshold // (200 - threshold))


def tell_tales(sets: dict[str, list[str]], threshold: int) -> list[str]:
    """Words of which every segment that reaches a template holds one: the template's bigrams without them are too few.

    The rarest come first, by length, and those that are words of earlier templates cost nothing.
    """
    chosen: set[str] = set()
    for own in sets.values():
        words = sorted({w for b in own for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w))
        without = lambda: sum(chosen.isdisjoint(b.split()) for b in own)  # noqa: B023, E731
        for w in words:
            if without() < needed(len(own), threshold):
                break
            chosen.add(w)
    return sorted(chosen)


def words_of(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), BREAK, -1), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of words."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))).otherwise(F.array().cast("array<string>")))[0]


def licences(df: DataFrame, id_column: str, text_column: str, templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_segments, n_matched, n_windows, licences, best, best_dice) for each row.

    n_segments: its distinct lines that aren't empty, and the whole text if it has several; n_matched: those of them that
    reach the threshold with a template; n_windows: windows that reach it with theirs, of each template and beginning; licences: the ids of all templates
    that are reached, sorted and comma-joined; best: the one of the highest coefficient, the first id of equals, or null;
    best_dice: its coefficient in whole millionths (rounded down), or null.
    """
    known = {k: v for k, v in sorted((templates or TEMPLATES).items()) if len(template_words(v)) > 1}
    sets = {k: template_bigrams(v) for k, v in known.items()}
    given = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    segments = F.filter(F.array_distinct(F.when(F.size(lines) > 1, F.array_append(lines, F.col("text"))).otherwise(lines)), lambda s: s != "")
    if not known:
        none = F.lit(None)
        return given.select(F.col("id").alias(id_column), F.size(segments).cast("long").alias("n_segments"), *[F.lit(0).cast("long").alias(c) for c in ("n_matched", "n_windows")], F.lit("").alias("licences"), none.cast("string").alias("best"), none.cast("long").alias("best_dice"))
    any_bigram = F.array(*[F.lit(x) for x in sorted(set().union(*sets.values()))])
    reach = lambda n: (n * threshold // (200 - threshold), -(-n * (200 - threshold) // threshold))
    least = min(reach(len(v))[0] for v in sets.values())
    most = max(reach(len(v))[1] for v in sets.values())
    letters = BREAK[2:-2]
    tale = F.lower("text").rlike(f"(?<![{letters}])(?:{'|'.join(tell_tales(sets, threshold))})(?![{letters}])")
    told = given.select("id", "text", tale.alias("told"))
    found = told.select("id", "told", segments.alias("segments"), F.unhex(F.sha2("text", 256)).alias("digest"))
    tried = F.filter(F.transform("segments", lambda s: bigrams(words_of(s))), lambda b: (F.size(b) > 0) & (F.size(b) >= least) & (F.size(b) <= most) & F.arrays_overlap(b, any_bigram))

    def match(b: Column, name: str) -> Column:
        """struct<d: -millionths, id> if the bigrams reach the template, else null."""
        own = sets[name]
        lo, hi = reach(len(own))
        common = F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in own]))).cast("long")
        total = F.size(b).cast("long") + len(own)
        near = F.size(b).between(lo, hi)
        return F.when(near & (F.when(near, common * 200).otherwise(0) >= threshold * total), F.struct((-(common * 2000000 - F.pmod(common * 2000000, total)) / total).cast("long").alias("d"), F.lit(name).alias("id")))

    matched = F.filter(F.transform(tried, lambda b: F.array_compact(F.array(*[match(b, k) for k in known]))), lambda x: F.size(x) > 0)
    hit = "struct<d: bigint, id: string>"
    lined = found.select("id", "digest", F.size("segments").cast("long").alias("n_segments"), F.when(F.col("told"), matched).otherwise(F.array().cast(f"array<array<{hit}>>")).alias("matched"))
    inside = windows(told.where("told").select("text"), known, sets, any_bigram, threshold)
    both = lined.join(inside, "digest", "left").withColumn("inside", F.coalesce("inside", F.array().cast(f"array<{hit}>")))
    hits = F.concat(F.flatten("matched"), F.col("inside"))
    best = F.array_min(hits)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["id"]))), ",")
    return both.select(F.col("id").alias(id_column), "n_segments", F.size("matched").cast("long").alias("n_matched"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), names.alias("licences"), best["id"].alias("best"), (-best["d"]).alias("best_dice"))


def windows(texts: DataFrame, known: dict[str, str], sets: dict[str, list[str]], any_bigram: Column, threshold: int) -> DataFrame:
    """(digest, n_windows, inside) of the different texts with a window that reaches its template: how many there are, and
    the best match struct<d, id> of each template.

    Only the parts of a text are looked at where some window has as many of the template's bigrams as it must; what lies
    farther away is in none of these windows. Between two places where a range of beginnings begins or ends, all windows
    have the same numbers of bigrams.
    """
    names = list(known)
    once = texts.groupBy(F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text"))
    bound = lambda value, function: F.transform(F.array(value), function)[0]  # noqa: E731  value is computed once
    numbers = lambda i, k: F.struct(F.lit(i).alias("t"), F.lit(len(template_words(known[k]))).alias("words"), F.lit(len(sets[k])).alias("own"), F.lit(needed(len(sets[k]), threshold)).alias("needed"), F.lit(k).alias("id"))
    enough = lambda shared, k: F.size(F.array_intersect(shared, F.array(*[F.lit(b) for b in sets[k]]))) >= needed(len(sets[k]), threshold)
    chosen = lambda shared: F.array_compact(F.array(*[F.when(enough(shared, k), numbers(i, k)) for i, k in enumerate(names)]))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    both = bound(words_of(F.col("text")), lambda w: bound(pairs(w), lambda p: F.struct(p.alias("pairs"), bound(F.array_intersect(p, any_bigram), chosen).alias("able"))))
    able = once.select("digest", both.alias("x")).select("digest", "x.pairs", "x.able")
    of: dict[str, list[int]] = {}
    for i, k in enumerate(names):
        for b in sets[k]:
            of.setdefault(b, []).append(i)
    table = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.array(*[F.lit(i) for i in v]).alias("of")) for b, v in sorted(of.items())]))
    lexicon = F.broadcast(texts.sparkSession.range(1).select(table.alias("e")).select("e.*"))  # the templates' bigrams, some hundreds
    # where a template's bigrams lie dense enough for a window: blocks as long as one, and those beside them
    hits = able.select("digest", "able", F.posexplode("pairs").alias("j", "b")).join(lexicon, "b").select("digest", "j", "of", F.explode("able").alias("n")).where(F.array_contains("of", F.col("n.t")))
    dense = lambda h, k: F.get("hits", (k + F.col("n.needed") - 1)) - h <= F.col("n.words") - 2
    block = lambda h: F.floor(h / F.col("n.words")).cast("int")
    starts = F.array_distinct(F.array_compact(F.transform("hits", lambda h, k: F.when(dense(h, k), block(h)))))
    zones = hits.groupBy("digest", "n").agg(F.array_sort(F.collect_list("j")).alias("hits")).select("digest", "n", starts.alias("starts"))
    around = F.filter(F.array_distinct(F.flatten(F.transform("starts", lambda b: F.array(b - 1, b, b + 1)))), lambda b: b >= 0)
    parts = zones.where("size(starts) > 0").join(able.select("digest", "pairs"), "digest").select("digest", "n", "pairs", F.explode(around).alias("block"))
    placed = parts.select("digest", "n", "block", F.posexplode(F.slice("pairs", F.col("block") * F.col("n.words") + 1, F.col("n.words"))).alias("k", "b")).select("digest", "n", "b", (F.col("block") * F.col("n.words") + F.col("k")).alias("j"))
    placed = placed.withColumn("before", F.lag("j").over(Window.partitionBy("digest", "n", "b").orderBy("j")))
    seen = placed.join(lexicon, "b", "left").select("digest", "n", "j", "before", F.coalesce("of", F.array().cast("array<int>")).alias("of"))
    held = F.array_contains("of", F.col("n.t")).cast("int")
    first = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("j") - F.col("n.words") + 2)
    turn = F.explode(F.array(F.struct(first.alias("i"), F.lit(1).alias("size"), held.alias("common")), F.struct((F.col("j") + 1).alias("i"), F.lit(-1).alias("size"), (-held).alias("common"))))
    turns = seen.select("digest", "n", turn.alias("e")).groupBy("digest", "n", "e.i").agg(F.sum("e.size").alias("size"), F.sum("e.common").alias("common"))
    along = Window.partitionBy("digest", "n").orderBy("i")
    state = turns.select("digest", "n", "i", F.lead("i").over(along).alias("to"), F.sum("size").over(along).alias("size"), F.sum("common").over(along).alias("common"))
    total = F.col("size") + F.col("n.own")
    near = state.where(F.col("to").isNotNull() & (F.col("common") * 200 >= threshold * total))
    scored = near.select("digest", F.col("n.id").alias("id"), (F.col("to") - F.col("i")).alias("many"), (-(F.col("common") * 2000000 - F.pmod(F.col("common") * 2000000, total)) / total).cast("long").alias("d"))
    best = scored.groupBy("digest", "id").agg(F.sum("many").alias("many"), F.min("d").alias("d"))
    return best.groupBy("digest").agg(F.sum("many").alias("n_windows"), F.collect_list(F.struct("d", "id")).alias("inside"))
