"""Licence scan with a positional rare-token index (operator 6), in DataFrame functions only.

Templates are phrases and whole licence texts; a text is taken sentence by sentence, so a holder's
name or a year between sentences moves nothing. The index holds the postings (passage, place) of
every template word. A file looks up its own licence words with the highest inverse document
frequency over the whole corpus (its LOOKED_UP rarest, if rare at all, and each word that is the rarest of some
passage, so a whole passage is always found). One pass over its words makes the postings of those words; file
place less template place is a candidate start, and at each start the passage's other words are met by
relative position. A template gives its label if enough of its words stand so, and its key phrases whole.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a file looks up besides the rarest words of passages, and the share of files that a rare word is in at most.
LOOKED_UP, RARE_SHARE = 16, 0.05
#: Share of a licence text's words that must stand in their places.
ENOUGH = 0.8


def split(text: str) -> list[str]:
    """The words of a template."""
    return re.findall("[a-z0-9]+", text.lower())


class Template(NamedTuple):
    """Passages that stand for a label; those in ``keys`` must be there whole."""

    label: str
    passages: tuple[str, ...]
    keys: tuple[str, ...] = ()
    base: bool = False
    enough: float = 1.0

    @property
    def parts(self) -> list[list[str]]:
        return [split(p) for p in (*self.passages, *self.keys)]

    @property
    def needed(self) -> int:
        return math.ceil(self.enough * sum(map(len, self.parts)))


def phrase(label: str, words: str, key: str = "", base: bool = False) -> Template:
    return Template(label, (words,), (key,) if key else (), base)


def text(label: str, sentences: str, *keys: str) -> Template:
    """A licence text, a sentence a line."""
    return Template(label, tuple(filter(None, map(str.strip, sentences.splitlines()))), keys, enough=ENOUGH)


AS_IS = "without warranty of any kind"

# Phrases of the contract, phrases of public licence texts with their key phrases,
# and public licence texts as their authors publish them.
TEMPLATES = (
    phrase("gpl", "gnu general public license", base=True),
    phrase("apache", "apache license", base=True),
    phrase("cc-by", "cc by", base=True),
    phrase("mit", "mit license", base=True),
    phrase("lgpl", "gnu lesser general public license"),
    phrase("agpl", "gnu affero general public license"),
    phrase("mpl", "mozilla public license"),
    phrase("mit", "permission is hereby granted free of charge", AS_IS),
    phrase("bsd", "redistribution and use in source and binary forms", "the following conditions are met"),
    phrase("isc", "permission to use copy modify and or distribute this software", "the software is provided as is"),
    phrase("apache", "licensed under the apache license", "version 2 0"),
    phrase("cc-by", "creative commons attribution", "international license"),
    text(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "to deal in the software without restriction",
    ),
    text(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "redistribution and use in source and binary forms",
    ),
    text(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "with or without fee is hereby granted",
    ),
    text(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty.
        In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        This notice may not be removed or altered from any source distribution.""",
        "must not be misrepresented",
    ),
    text(
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
        "under the apache license version 2 0",
    ),
    text(
        "gpl",
        """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program""",
        "under the terms of the gnu general public license",
    ),
    text(
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at""",
        "subject to the terms of the mozilla public license",
    ),
    text(
        "unlicense",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unencumbered software released into the public domain",
    ),
)
#: The distinct passages, and for each template the numbers of its passages and of its key phrases.
PASSAGES = sorted({tuple(words) for t in TEMPLATES for words in t.parts})
NUMBER = {words: k for k, words in enumerate(PASSAGES)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no part of a word: every ASCII character but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; empty for null.

    ``lower`` also changes other letters, which is of no account to words that are counted and
    compared with ASCII phrases; only the Kelvin sign would become an ASCII letter, and so is
    replaced by another letter first.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def vocabulary() -> list[str]:
    return sorted({w for words in PASSAGES for w in words})


def document_frequencies(files: DataFrame, words_col: str = "words") -> tuple[int, dict[str, int]]:
    """Number of files, and of files that hold each template word: one row a word, over all files."""
    own = F.array_intersect(F.col(words_col), F.array(*map(F.lit, vocabulary())))
    counts = files.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counts}
    return found.get("", 0), {w: found.get(w, 0) for w in vocabulary()}


def idf(total: int, df: int) -> float:
    return math.log((1 + total) / (1 + df))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


class Index(NamedTuple):
    """The templates' words by rarity in a corpus of ``total`` files: fixed in size by the templates."""

    total: int
    df: dict[str, int]

    @property
    def order(self) -> list[str]:
        """All template words, the rarest first."""
        return sorted(self.df, key=lambda w: (self.df[w], w))

    @property
    def rare(self) -> list[str]:
        return [w for w in self.order if self.df[w] <= RARE_SHARE * self.total]

    @property
    def anchors(self) -> list[str]:
        """The rarest word of each passage."""
        return sorted({min(words, key=lambda w: (self.df[w], w)) for words in PASSAGES})

    def weight(self, word: str) -> float:
        return idf(self.total, self.df[word])

    def postings(self) -> Column:
        """Map from a template word to where it stands: (passage, place)."""
        at: dict[str, list[Column]] = {}
        for k, words in enumerate(PASSAGES):
            for place, word in enumerate(words):
                at.setdefault(word, []).append(F.struct(F.lit(k).alias("passage"), F.lit(place).alias("place")))
        return F.create_map(*[c for w, where in at.items() for c in (F.lit(w), F.array(*where))])

    def slots(self) -> Column:
        """For each passage its words, each with its weight."""
        slot = lambda w: F.struct(F.lit(w).alias("word"), F.lit(self.weight(w)).alias("weight"))
        return F.array(*[F.array(*map(slot, words)) for words in PASSAGES])


def _looked_up(index: Index) -> Column:
    """The licence words that a file looks up, from the words it ``held`` (the rarest first)."""
    rarest = F.slice(F.array_intersect("held", _strings(index.rare)), 1, LOOKED_UP)
    return F.array_union(rarest, F.array_intersect("held", _strings(index.anchors)))


def _file_postings() -> Column:
    """Map from each looked-up word to its places, from one pass over the words."""
    places = F.array_compact(F.transform("words", lambda w, i: F.when(F.array_contains("looked", w), F.struct(w.alias("word"), i.alias("at")))))
    return F.when(F.size("looked") > 0, places).otherwise(F.array().cast("array<struct<word:string,at:int>>"))


def _grouped() -> Column:
    of_word = lambda w: F.transform(F.filter("hits", lambda h: h["word"] == w), lambda h: h["at"])
    return F.map_from_entries(F.transform("looked", lambda w: F.struct(w, F.when(F.size("hits") > 0, of_word(w)))))


def _candidates(index: Index) -> Column:
    """Distinct (passage, start) at which a looked-up word stands in its place."""
    by_word = F.transform(
        F.map_entries("postings"),
        lambda e: F.flatten(
            F.transform(
                e["value"],
                lambda at: F.transform(
                    F.element_at(index.postings(), e["key"]),
                    lambda p: F.struct(p["passage"].alias("passage"), (at - p["place"]).alias("start")),
                ),
            )
        ),
    )
    return F.array_distinct(F.filter(F.flatten(by_word), lambda c: c["start"] >= 0))


def _met(index: Index) -> Column:
    """Each candidate with the number and the weight of the passage's words that stand in place."""

    def meet(c: Column) -> Column:
        slots = F.get(index.slots(), c["passage"])
        here = F.slice(F.col("words"), c["start"] + 1, F.size(slots))
        same = F.filter(F.zip_with(here, slots, lambda w, s: F.when(w == s["word"], s["weight"])), lambda x: x.isNotNull())
        return F.struct(
            c["passage"].alias("passage"),
            c["start"].alias("start"),
            F.size(same).alias("n"),
            F.aggregate(same, F.lit(0.0), lambda a, x: a + x).alias("weight"),
        )

    return F.transform("candidates", meet)


def _best() -> Column:
    """For each passage the most words, and the most weight, that stand in place around one start."""
    most = lambda k, of: F.coalesce(F.array_max(F.transform(F.filter("met", lambda m: m["passage"] == k), lambda m: m[of])), F.lit(0))
    numbers = F.array(*map(F.lit, range(len(PASSAGES))))
    return F.when(F.size("met") > 0, F.transform(numbers, lambda k: F.struct(most(k, "n").alias("n"), most(k, "weight").alias("weight"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_words``, ``places`` (for each template of one
    passage the starts of that passage as a whole; empty for others), ``base_labels`` and ``labels`` (distinct, sorted) and ``score``.

    The score is 1 with a label, else the largest share of a template's IDF weight (key phrases
    included) that stands in place, to six digits. A null or empty
    text has no word, no place, no label and score 0. Repeated rows and null ids are kept; other columns
    are not read, so their names may clash.
    """
    files = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    index = Index(*document_frequencies(files))
    # a step a column: what a later step uses more than once is computed once
    steps = files.withColumn("held", F.array_intersect(_strings(index.order), "words"))
    steps = steps.withColumn("looked", _looked_up(index))
    steps = steps.withColumn("hits", _file_postings())
    steps = steps.withColumn("postings", _grouped())
    steps = steps.withColumn("candidates", _candidates(index))
    steps = steps.withColumn("met", _met(index))
    steps = steps.withColumn("best", _best())

    def starts(t: Template) -> Column:
        words = t.parts[0]
        whole = F.filter("met", lambda m: (m["passage"] == NUMBER[tuple(words)]) & (m["n"] == len(words)))
        return F.array_sort(F.transform(whole, lambda m: m["start"]))

    def of(words: list[str], field: str) -> Column:
        return F.get("best", F.lit(NUMBER[tuple(words)]))[field]

    def total(t: Template, field: str) -> Column:
        return reduce(lambda a, b: a + b, [of(words, field) for words in t.parts])

    def holds(t: Template) -> Column:
        keys = [of(split(k), "n") == len(split(k)) for k in t.keys]
        return reduce(lambda a, b: a & b, keys, total(t, "n") >= t.needed)

    def share(t: Template) -> Column:
        whole = sum(index.weight(w) for words in t.parts for w in words)
        return total(t, "weight") / whole if whole > 0 else F.lit(0.0)

    got = [F.when(holds(t), F.lit(t.label)) for t in TEMPLATES]
    distinct = lambda labels: F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    none = F.array().cast("array<int>")
    labelled = steps.select(
        F.col("id"),
        F.size("words").cast("long").alias("n_words"),
        F.array(*[starts(t) if len(t.parts) == 1 else none for t in TEMPLATES]).alias("places"),
        distinct([g for g, t in zip(got, TEMPLATES) if t.base]).alias("base_labels"),
        distinct(got).alias("labels"),
        F.coalesce(F.greatest(*[share(t) for t in TEMPLATES]), F.lit(0.0)).alias("share"),
    )
    score = F.when(F.size("labels") > 0, F.lit(1.0)).otherwise(F.round("share", 6))
    return labelled.select(F.col("id").alias(id_col), "n_words", "places", "base_labels", "labels", score.alias("score"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query."""
    base = F.array_sort(F.flatten(F.array(*[F.get("places", F.lit(k)) for k, t in enumerate(TEMPLATES) if t.base])))
    return scanned.select(
        F.col(id_col),
        F.col("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.col("score"),
    )


def oracle() -> str:
    """The query's rows in DuckDB SQL: postings of the template words joined with the passages."""
    slots = ", ".join(f"({k}, {place}, '{w}')" for k, words in enumerate(PASSAGES) for place, w in enumerate(words))
    sizes = ", ".join(f"({k}, {len(words)})" for k, words in enumerate(PASSAGES))
    heads = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()}, {x.needed})" for t, x in enumerate(TEMPLATES))
    keys = [[tuple(split(k)) for k in x.keys] for x in TEMPLATES]
    parts = ", ".join(
        f"({t}, {NUMBER[tuple(words)]}, {str(tuple(words) in keys[t]).lower()})" for t, x in enumerate(TEMPLATES) for words in x.parts
    )
    return f"""
with files as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from documents),
slot(p, place, word) as (values {slots}),
size(p, size) as (values {sizes}),
head(t, label, base, needed) as (values {heads}),
part(t, p, key) as (values {parts}),
posting as (
  select rid, word, pos - 1 as pos
  from (select rid, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from files)
  where word in (select word from slot)),
frequency as (
  select word, ln((1 + (select count(*) from files)) / (1 + coalesce(n, 0))) as weight, coalesce(n, 0) as n
  from (select distinct word from slot) left join (select word, count(distinct rid) as n from posting group by word) using (word)),
anchor as (select distinct w as word from (select arg_min(word, (n, word)) as w from slot join frequency using (word) group by p)),
held as (select rid, word, n, row_number() over (partition by rid order by n, word) as place from (select distinct rid, word from posting) join frequency using (word)),
looked as (
  select rid, word from held
  where word in (select word from anchor) or (place <= {LOOKED_UP} and n <= {RARE_SHARE}::double * (select count(*) from files))),
met as (
  select rid, s.p, pos - s.place as start, count(*) as n, sum(weight) as weight
  from posting x join slot s using (word) join frequency using (word) left join looked l using (rid, word)
  group by rid, s.p, pos - s.place having bool_or(l.rid is not null) and pos - s.place >= 0),
best as (select rid, p, max(n) as n, max(weight) as weight from met group by rid, p),
whole as (select t, sum(weight) as weight from part join slot using (p) join frequency using (word) group by t),
got as (
  select rid, t, sum(n) as n, sum(b.weight) / any_value(nullif(w.weight, 0)) as share, count(*) filter (where key and n = size) as keys
  from best b join part using (p) join size using (p) join whole w using (t) group by rid, t),
label as (
  select distinct rid, label, base from got join head using (t)
  where n >= needed and keys = (select count(*) from part k where k.t = got.t and k.key)),
based as (
  select rid, count(*) as n_base, min(start) as first_word, max(start) as last_word
  from met join size using (p) join part using (p) join head using (t) where base and n = size group by rid),
labels as (
  select rid, string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
    string_agg(distinct label, ',' order by label) as labels from label group by rid),
share as (select rid, max(share) as share from got group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when labels is not null then 1.0::double else round(coalesce(share, 0.0)::double, 6) end as score
from files left join based using (rid) left join labels using (rid) left join share using (rid)
"""
