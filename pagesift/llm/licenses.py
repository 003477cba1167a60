"""License scans: template markup compiled into token automata.

A template is license wording with marked regions. ``<<beginOptional>>`` ... ``<<endOptional>>`` may be left out;
``<<var;name="holder";match=".+">>`` may be replaced: ``.+`` stands for 1 to ``MOST_WORDS`` words, ``.*`` for none or
more, ``.{2,5}`` for so many words, and anything else lists the wordings allowed, parted by ``|``. All other words are
mandatory and have to stand in the text, in order and without others between them.

All templates become one non-deterministic automaton over words. It is made deterministic as texts need it; the
states met are kept, up to a bound, so that a word costs one look-up. A text is read from each word that can begin a
template; no region is without bound, so a start is followed for no more words than the longest template allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table

MOST_WORDS = 12
#: Transitions that a worker keeps; beyond them it begins anew.
MOST_KEPT = 200_000
#: Letters as they count, and a space for each byte that is in no word: words are a-z, 0-9 and what isn't ASCII.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
_MARK = re.compile(r'<<(\w+)((?:;\w+="[^"]*")*)>>')


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z as a-z."""
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Template:
    """``base`` marks a plain phrase whose every place counts."""

    label: str
    markup: str
    base: bool = False


#: A parsed region: ("word", w), ("optional", items), ("any", least, most) or ("one of", [items, ...]).
Item = tuple


def _region(match: str) -> Item:
    if match in (".+", ".*"):
        return ("any", int(match == ".+"), MOST_WORDS)
    if bounds := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
        return ("any", int(bounds[1]), int(bounds[2]))
    return ("one of", [[("word", w) for w in words_of(x.encode())] for x in match.split("|")])


def parsed(markup: str) -> list[Item]:
    """The regions of a template. Regions at its ends that may be absent are left out: they decide nothing."""
    stack: list[list[Item]] = [[]]
    at = 0
    for m in [*_MARK.finditer(markup), None]:
        stack[-1] += [("word", w) for w in words_of(markup[at : m.start() if m else None].encode())]
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m[1] == "var":
            stack[-1].append(_region(dict(re.findall(r';(\w+)="([^"]*)"', m[2])).get("match", ".+")))
        else:
            raise ValueError(f"unknown or unopened mark {m[0]}")
    if len(stack) > 1:
        raise ValueError("an optional region is not closed")
    items = stack[0]
    for end in (0, -1):
        while items and items[end][0] in ("optional", "any"):
            items.pop(end)
    if not items:
        raise ValueError("a template needs mandatory words")
    return items


def mandatory_words(items: list[Item]) -> int:
    return sum(x[0] == "word" for x in items)


@dataclass
class Automaton:
    """The templates' states: what each word, any word and no word at all lead to."""

    templates: tuple[Template, ...]
    by_word: list[dict[bytes, list[int]]] = field(default_factory=list)
    by_any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.ends: dict[int, int] = {}
        starts = []
        for i, t in enumerate(self.templates):
            starts.append(self._state())
            self.ends[self._run(parsed(t.markup), starts[-1])] = i
        self.vocabulary = {w for x in self.by_word for w in x}
        self._sets: dict[frozenset, int] = {}
        self._members: list[frozenset] = []
        self._told: list[tuple[int, ...]] = []
        self._moves: list[dict[bytes | None, int]] = []
        self._kept, self._starts = 0, starts
        self._reset()
        self.first = {w for s in self._members[self.start] for w in self.by_word[s]}
        self.open = any(self.by_any[s] for s in self._members[self.start])

    def _reset(self) -> None:
        self._sets.clear(), self._members.clear(), self._told.clear(), self._moves.clear()
        self._kept = 0
        self.dead, self.start = self._id(frozenset()), self._id(self._closed(self._starts))

    def _state(self) -> int:
        self.by_word.append({}), self.by_any.append([]), self.free.append([])
        return len(self.free) - 1

    def _run(self, items: list[Item], at: int) -> int:
        """Adds the items after state ``at``; the state where they end."""
        for x in items:
            if x[0] == "word":
                to = self._state()
                self.by_word[at].setdefault(x[1], []).append(to)
            elif x[0] == "any":
                to = at
                exits = [at] if x[1] == 0 else []
                for k in range(x[2]):
                    step = self._state()
                    self.by_any[to].append(step)
                    to = step
                    if k + 1 >= x[1]:
                        exits.append(to)
                to = self._state()
                for e in exits:
                    self.free[e].append(to)
            else:
                to = self._state()
                for inner in [x[1], []] if x[0] == "optional" else x[1]:
                    way = self._state()
                    self.free[at].append(way)
                    self.free[self._run(inner, way)].append(to)
            at = to
        return at

    def _closed(self, states: Iterable[int]) -> frozenset:
        found, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in found:
                found.add(s)
                todo += self.free[s]
        return frozenset(found)

    def _id(self, members: frozenset) -> int:
        if members not in self._sets:
            self._sets[members] = len(self._members)
            self._members.append(members)
            self._told.append(tuple(sorted(self.ends[s] for s in members if s in self.ends)))
            self._moves.append({})
        return self._sets[members]

    def _move(self, state: int, word: bytes | None) -> int:
        to = [t for s in self._members[state] for t in [*self.by_any[s], *self.by_word[s].get(word, ())]]
        self._kept += 1
        return self._moves[state].setdefault(word, self._id(self._closed(to)))

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) of each place, in words, the end exclusive; of ends after one start the first."""
        if self._kept > MOST_KEPT:
            self._reset()
        out, known, n = [], self.vocabulary, len(words)
        starts = range(n) if self.open else [i for i, w in enumerate(words) if w in self.first]
        for i in starts:
            state, seen = self.start, set()
            for j in range(i, n):
                word = words[j] if words[j] in known else None
                to = self._moves[state].get(word)
                state = self._move(state, word) if to is None else to
                for t in self._told[state]:
                    if t not in seen:
                        seen.add(t)
                        out.append((t, i, j + 1))
                if state == self.dead:
                    break
        return out


#: The phrases of the base labels, and wordings of public licenses and of their usual notices.
TEMPLATES = (
    Template("mit", "under the MIT license", base=True),
    Template("apache-2", "Apache License Version 2", base=True),
    Template("cc-by-nc", "CC BY NC", base=True),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";match="this software and associated documentation files|this software">> <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, <<beginOptional>>sublicense,<<endOptional>> and/or sell copies of the Software'),
    Template("isc", 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software <<beginOptional>>and its documentation<<endOptional>> for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies'),
    Template("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;name="bullet";match=".{0,1}">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;name="bullet";match=".{0,1}">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    Template("bsd-3-clause", 'Neither the name of <<var;name="holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission'),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;name=\"who\";match=\"author|authors\">> be held liable for any damages arising from the use of this software."),
    Template("unlicense", 'This is free and unencumbered software released into the public domain'),
    Template("bsl-1", 'Boost Software License <<beginOptional>>-<<endOptional>> Version 1.0'),
    Template("apache-2", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    Template("apache-2", 'Licensed under <<beginOptional>>the<<endOptional>> Apache <<beginOptional>>License<<endOptional>> <<beginOptional>>Version<<endOptional>> <<var;name="version";match="2.0|v2.0|2|v2">>'),
    Template("mit", '<<var;name="verb";match="Released|Licensed|Distributed|Available">> under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>X11<<endOptional>> license'),
    Template("gpl-3", 'under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3'),
    Template("gpl-2", 'under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 2'),
    Template("lgpl", 'under the <<beginOptional>>terms of the<<endOptional>> GNU <<var;name="old";match="Lesser|Library">> General Public License'),
    Template("agpl-3", 'under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License'),
    Template("mpl-2", 'This Source Code Form is subject to the terms of the Mozilla Public License, v<<beginOptional>>ersion<<endOptional>>. 2.0'),
    Template("mpl-2", '<<var;name="verb";match="Released|Licensed|Distributed|Available">> under the <<beginOptional>>terms of the<<endOptional>> Mozilla Public License <<beginOptional>>Version<<endOptional>> 2.0'),
    Template("cc-by-nc", 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-NonCommercial <<var;name="version";match=".{0,3}">> <<beginOptional>>International<<endOptional>> License'),
    Template("cc-by-sa", 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-ShareAlike <<var;name="version";match=".{0,3}">> <<beginOptional>>International<<endOptional>> License'),
    Template("cc-by", 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<var;name="version";match="1.0|2.0|2.5|3.0|4.0">> <<beginOptional>>International<<endOptional>> License'),
    Template("cc0", 'dedicated <<beginOptional>>this work<<endOptional>> to the public domain <<beginOptional>>worldwide<<endOptional>> under CC0'),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    Template("gpl-3", 'SPDX-License-Identifier: GPL-3.0<<beginOptional>>-only<<endOptional>>'),
    Template("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    Template("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC-4.0"),
)


@lru_cache(maxsize=4)
def automaton(templates: tuple[Template, ...] = TEMPLATES) -> Automaton:
    return Automaton(templates)


def weight(template: Template) -> float:
    """How sure a match is, from 0 to 1: more the more words are mandatory."""
    n = mandatory_words(parsed(template.markup))
    return n / (n + 4)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, matches array<struct<label, base, weight, start, end>>) per row, matches by start.

    Start and end are word numbers from 0, the end exclusive. Null and empty texts have no words. Rows that repeat give
    results that repeat, ids may be null, an empty table gives an empty result, and other columns are not read.
    """
    told = [(t.label, t.base, weight(t)) for t in templates]

    def run(batches):
        import pyarrow as pa

        found, kind = automaton(templates), pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("weight", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, matches = [], []
            for text in b.column(1).to_pylist():
                words = words_of(text or b"")
                n.append(len(words))
                matches.append([{"label": told[t][0], "base": told[t][1], "weight": told[t][2], "start": i, "end": j} for t, i, j in found.matches(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(matches, kind)], [id_col, "n_words", "matches"])

    kind = dict(df.dtypes)[id_col]
    return in_arrow(df.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, n_words long, matches array<struct<label: string, base: boolean, weight: double, start: long, end: long>>")


def op12_licenses(spark, sf_dir):
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    place: Column = F.transform(base, lambda m: m["start"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0.0)).alias("score"),
    )


def _pattern(items: list[Item]) -> str:
    """The items as a regular expression over words that a space follows each."""
    out = ""
    for x in items:
        if x[0] == "word":
            out += x[1].decode() + " "
        elif x[0] == "any":
            out += f"([^ ]+ ){{{x[1]},{x[2]}}}"
        elif x[0] == "optional":
            out += f"({_pattern(x[1])})?"
        else:
            out += "(" + "|".join(map(_pattern, x[1])) + ")"
    return out


def _sql() -> str:
    base, places = [t for t in TEMPLATES if t.base], []
    for i, t in enumerate(base):
        words = [w.decode() for w in words_of(t.markup.encode())]
        places.append(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(words)}] = {words}) AS p{i}")
    tests = [f"CASE WHEN regexp_matches(s, ' {_pattern(parsed(t.markup))}') THEN {{'label': '{t.label}', 'weight': {weight(t)!r}::DOUBLE}} END" for t in TEMPLATES]
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
found AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, {', '.join(places)}, ' ' || array_to_string(w, ' ') || ' ' AS s FROM words),
judged AS (
  SELECT *, p0 || p1 || p2 AS p, list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL) AS m FROM found)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       array_to_string(list_filter(['{base[1].label}', '{base[2].label}', '{base[0].label}'], lambda x: CASE x WHEN '{base[0].label}' THEN len(p0) WHEN '{base[1].label}' THEN len(p1) ELSE len(p2) END > 0), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(m, lambda x: x.label))), ',') AS labels,
       coalesce(list_max(list_transform(m, lambda x: x.weight)), 0)::DOUBLE AS score
FROM judged"""


SQL = {"op12_licenses": _sql()}
QUERIES = {"op12_licenses": op12_licenses}
