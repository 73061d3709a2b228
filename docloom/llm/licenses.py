"""License scans: exact phrases, and a set-similarity join of text blocks with license templates.

Blocks are the lines of a text and its paragraphs (parted by blank lines), so that a notice that is wrapped over lines is one
block; both as sets of words. A block matches a template if it holds at least THRESHOLD of the
template's words. The join is exact and orders words by how many documents hold them, rarest first, counted over the
whole corpus: a match must hold one of the rarest words of a template (prefix filter), have as many words as the match
needs (length filter), and have enough words left after the first common one (positional filter). Templates are a
parameter, some kilobytes of text; their prefix index goes to the tasks, so texts stay where they are.

Null texts count as empty. Rows that repeat a doc_id get a row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import folded_words, read, utf8

THRESHOLD = 0.8

# Phrases that count wherever their words stand in a row, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices as templates, with their labels.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("All rights reserved", "reserved"),
)

# Paragraphs of public license texts, with their labels.
FULL_TEXTS = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:",
        "mit",
    ),
    (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES"
        " OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS"
        " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
        " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission.",
        "bsd-3-clause",
    ),
    (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,"
        " BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT"
        " SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
        " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR"
        " PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR"
        " TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
        " POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2.0",
    ),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
        " language governing permissions and limitations under the License.",
        "apache-2.0",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
        " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gpl-3.0",
    ),
    (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl-2.0",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for"
        " any damages arising from the use of this software.",
        "zlib",
    ),
)
EVERY_TEMPLATE = TEMPLATES + FULL_TEXTS


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # rarest first
    ranks: tuple[int, ...]  # their places in the order of all templates' words
    needed: int  # common words of a match


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """The least whole number of n words that makes up the threshold."""
    k = max(1, int(n * threshold))
    return k if k >= n * threshold - 1e-9 else k + 1


def word_sets(templates=EVERY_TEMPLATE) -> list[tuple[frozenset[bytes], str]]:
    found = [(frozenset(folded_words(text.encode())), label) for text, label in templates]
    return [(w, label) for w, label in found if w]


def document_counts(documents: DataFrame, words: frozenset[bytes]) -> DataFrame:
    """word, n: by how many documents each of these words is held."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in utf8(batch, "text"):
                for w in words.intersection(folded_words(text)):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ordered_templates(documents: DataFrame, templates=EVERY_TEMPLATE) -> list[Template]:
    sets = word_sets(templates)
    every = frozenset().union(*(w for w, _ in sets))
    counts = {bytes(r["word"]): r["n"] for r in document_counts(documents, every).collect()}  # as many rows as template words
    rank = {w: i for i, w in enumerate(sorted(every, key=lambda x: (counts.get(x, 0), x)))}
    out = []
    for words, label in sets:
        ordered = tuple(sorted(words, key=rank.__getitem__))
        out.append(Template(label, ordered, tuple(rank[w] for w in ordered), needed(len(words))))
    return out


class Matcher:
    """Finds the templates that a block matches."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.rank = {w: r for t in templates for w, r in zip(t.words, t.ranks)}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(t.words[: len(t.words) - t.needed + 1]):
                self.prefix.setdefault(w, []).append((k, i))

    def matches(self, block: list[bytes]) -> list[tuple[int, int]]:
        """(template, common words) of a block."""
        held = set(block)
        known = sorted(held & self.rank.keys(), key=self.rank.__getitem__)
        seen, out = set(), []
        for j, w in enumerate(known):
            for k, i in self.prefix.get(w, ()):
                t = self.templates[k]
                if k in seen or len(held) < t.needed:
                    continue
                seen.add(k)  # the first common word, as both sides are in one order
                if 1 + min(len(t.words) - i - 1, len(known) - j - 1) < t.needed:
                    continue
                common = sum(x in held for x in t.words)
                if common >= t.needed:
                    out.append((k, common))
        return out


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """The words (from 0) at which the phrase starts in blank-separated words with a blank at either end."""
    out, needle, done, word = [], b" " + phrase + b" ", 0, 0
    at = joined.find(needle)
    while at >= 0:
        word += joined.count(b" ", done, at)
        out.append(word)
        done, at = at, joined.find(needle, at + 1)
    return out


_BLANK_LINE = re.compile(rb"\n[ \t\r]*\n")


def blocks_of(text: bytes) -> list[bytes]:
    """The lines of a text, and behind them its paragraphs of more than one line."""
    return text.split(b"\n") + [p for p in _BLANK_LINE.split(text) if b"\n" in p]


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(documents: DataFrame, templates=EVERY_TEMPLATE, phrases=PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the greatest share of a matched template's words held by one block, else 0.
    """
    ordered = ordered_templates(documents, templates)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(ordered)
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows = []
            for text in utf8(batch, "text"):
                words = folded_words(text)
                joined = b" " + b" ".join(words) + b" "
                places, base = [], set()
                for phrase, label in phrases:
                    if got := phrase_places(joined, phrase.encode()):
                        places += got
                        base.add(label)
                labels, score = set(base), 1.0 if base else 0.0
                if not matcher.prefix.keys().isdisjoint(words):
                    for block in blocks_of(text):
                        for k, common in matcher.matches(folded_words(block)):
                            labels.add(matcher.templates[k].label)
                            score = max(score, common / len(matcher.templates[k].words))
                rows.append(
                    (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
                )
            cols = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT}")


def matching_blocks(documents: DataFrame, templates=EVERY_TEMPLATE) -> DataFrame:
    """The join itself: doc_id, block (place among the lines, then the paragraphs), template (text), label, common, share."""
    ordered = ordered_templates(documents, templates)
    texts = [text for text, _ in templates if folded_words(text.encode())]
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher = Matcher(ordered)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                for at, block in enumerate(blocks_of(text)):
                    for k, common in matcher.matches(folded_words(block)):
                        t = matcher.templates[k]
                        rows.append((doc_id, at, texts[k], t.label, common, common / len(t.words)))
            cols = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "block", "template", "label", "common", "share"]
            )

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, block int, template string, label string, common int, share double"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every phrase at every word, and every line and paragraph against every template."""

    def quoted(words) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"

    phrases = " UNION ALL ".join(f"SELECT {quoted(p.encode().split())} AS p, '{label}' AS label" for p, label in PHRASES)
    templates = " UNION ALL ".join(
        f"SELECT {quoted(sorted(w))} AS t, {needed(len(w))} AS needed, '{label}' AS label" for w, label in word_sets()
    )
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH phrases AS ({phrases}), templates AS ({templates}),
d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT k, label, s FROM (SELECT k, w, unnest(range(0, len(w))) AS s FROM d), phrases
  WHERE w[s + 1] = p[1] AND w[s + 1 : s + len(p)] = p),
base AS (
  SELECT k, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY k),
blocks AS (SELECT k, list_distinct({words.format('line')}) AS b FROM (
  SELECT k, unnest(string_split(text, chr(10)) || list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10)))) AS line FROM d)),
joined AS (SELECT k, label, needed, len(list_intersect(b, t)) AS common, len(t) AS n FROM blocks, templates),
method AS (SELECT k, list(DISTINCT label) AS ls, max(common / n) AS share FROM joined WHERE common >= needed GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(base.ls, []) || coalesce(method.ls, []))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN method USING (k)
"""


ORACLE = _oracle()
