"""License templates against a plain matcher that tries every way through the markup."""

import re

import pytest

from pagesift.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ways(items, words, at):
    """All ends of the items from word ``at``, by backtracking."""
    if not items:
        return {at}
    head, rest, out = items[0], items[1:], set()
    if head[0] == "word":
        return ways(rest, words, at + 1) if words[at : at + 1] == [head[1].decode()] else out
    if head[0] == "any":
        for k in range(head[1], head[2] + 1):
            if at + k <= len(words):
                out |= ways(rest, words, at + k)
        return out
    for inner in [head[1], []] if head[0] == "optional" else head[1]:
        for mid in ways(inner, words, at):
            out |= ways(rest, words, mid)
    return out


def plain_matches(templates, words):
    return sorted((t, i, min(ends)) for t, x in enumerate(templates) for i in range(len(words)) if (ends := ways(L.parsed(x.markup), words, i)))


TEMPLATES = (
    L.Template("a", 'one <<beginOptional>>two <<beginOptional>>and a half<<endOptional>><<endOptional>> three <<var;name="x";match=".+">> end'),
    L.Template("b", '<<beginOptional>>dropped<<endOptional>> two <<var;name="x";match="up to|till|">> <<var;name="n";match=".{0,2}">> three'),
    L.Template("c", "one one two", base=True),
    L.Template("d", 'end <<var;name="y";original="<year> of it";match=".*">>'),
)
TEXTS = [
    "", "one two three x end", "One TWO and-a half three end end", "one three end", "one three " + "w " * 12 + "end", "one three " + "w " * 13 + "end", "one one one two up to here there three", "two till three two three four five three",
    "two up three", "oné two three é end", "one  two\tand a. Half three\nß end of one one two", "END", "K one three K end",
]


@pytest.mark.parametrize("text", TEXTS)
def test_automaton_matches_as_backtracking_does(text):
    words = plain_words(text)
    assert [w.decode() for w in L.words_of(text.encode())] == words
    assert sorted(L.Automaton(TEMPLATES).matches([w.encode() for w in words])) == plain_matches(TEMPLATES, words)


def test_states_are_dropped_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(L, "MOST_KEPT", 3)
    found = L.Automaton(TEMPLATES)
    for text in TEXTS * 2:
        words = L.words_of(text.encode())
        assert sorted(found.matches(words)) == plain_matches(TEMPLATES, [w.decode() for w in words])


@pytest.mark.parametrize("markup", ["<<beginOptional>>a", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", '<<var;name="x";match=".+">>', "", "a <<other>>"])
def test_templates_that_are_refused(markup):
    with pytest.raises(ValueError):
        L.parsed(markup)


def test_mandatory_wording_must_match_exactly():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    labels = lambda text: {L.TEMPLATES[t].label for t, _, _ in L.automaton().matches(L.words_of(text.encode()))}
    assert labels(mit) == labels(mit.replace(" sublicense,", "")) == {"mit"}
    assert labels(mit.replace("any person", "each person")) == labels(mit.replace("merge, ", "")) == set()
    assert labels("Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.") == {"bsd-3-clause"}
    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl-3"}
    assert labels("SPDX-License-Identifier: Apache-2.0") == {"apache-2"}


def test_query_on_odd_rows(spark, tmp_path):
    """Null and empty texts, long ones, repeated rows, null ids, clashing columns, and no rows."""
    long = "x " * 200_000 + "Under the MIT License. cc-by, nc " * 3
    rows = [(1, None, 5), (2, "", 6), (None, "under the mit license version 2 Apache License, version 2", 7), (3, long, 8), (3, long, 8), (4, "under the mit licenses", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op12_licenses(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == [
        (0, 10, 2, 0, 6, "apache-2,mit"), (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""),
        (3, 200_021, 6, 200_000, 200_018, "cc-by-nc,mit"), (3, 200_021, 6, 200_000, 200_018, "cc-by-nc,mit"), (4, 4, 0, None, None, ""),
    ]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert L.scan(df.limit(0)).count() == 0
