"""The secret field on forms it was never trained on, planted in real documents, and its decoding against all paths."""

import itertools
import random
import string

import numpy as np
import pytest

from pagesift.llm import secrets
from pagesift.llm.common import table
from pagesift.llm.crf import LinearChain

SF = "/root/testdata/sf0.01"
#: Forms that the training lines don't have; few of them match a pattern.
FORMS = [
    ("machine host login anna password ", ""), ("deploy --token ", " --force"), ('<add key="DbPassword" value="', '"/>'), ('"pass": "', '"'), ("postgres://app:", "@db.example.com/x"), ("Authorization: Bearer ", ""),
]


def value(rng: random.Random) -> str:
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(14, 24)))


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text or "" for r in table(spark, SF, "documents").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def scanner(spark):
    background = secrets.background_lines(table(spark, SF, "documents"), "text")
    assert len(background) >= secrets.LEAST_LINES
    return secrets.Scanner(secrets.field(background))


def test_planted_secrets_of_other_forms(documents, scanner):
    rng = random.Random(11)
    found = beyond = 0
    for before, after in FORMS:
        for _ in range(25):
            secret, doc = value(rng), rng.choice(documents)
            text = f"{doc}\n{before}{secret}{after}\n"
            at = len(doc) + 1 + len(before)
            want = set(range(at, at + len(secret)))
            spans = {i for a, z in scanner.spans(text) for i in range(a, z)}
            base = {i for a, z, _ in secrets.base_spans(text) for i in range(a, z)}
            found += want <= spans
            beyond += want <= spans and not want <= base
    assert found >= 0.8 * 25 * len(FORMS)
    assert beyond >= 0.75 * 25 * len(FORMS)


def test_few_findings_in_documents_without_secrets(documents, scanner):
    wrong = 0
    for text in documents:
        base = secrets.base_spans(text)
        wrong += sum(not any(s < z and a < e for s, e, _ in base) for a, z in scanner.spans(text))
    assert wrong <= len(documents) // 100


def test_query_finds_more_than_the_patterns(spark, documents):
    rng = random.Random(3)
    rows = [(i, t + (f"\nmachine h login u password {value(rng)}\n" if i % 5 == 0 else "")) for i, t in enumerate(documents)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()
    more = {r.doc_id for r in got if "crf" in (r.spans or "")}
    assert len(more & set(range(0, len(rows), 5))) >= 0.6 * len(rows) / 5
    for r in got:
        base = secrets.base_spans(dict(rows)[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == [f"{k}:{a}:{z}" for a, z, k in base]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(60):
        field = LinearChain(1)
        field.transitions, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
        em = rng.normal(size=(rng.integers(1, 7), 3)) * 2
        tr, st = field.transitions + field.forbidden, field.start + field.not_first

        def score(path):
            return st[path[0]] + sum(em[i, t] for i, t in enumerate(path)) + sum(tr[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(3), repeat=len(em)), key=score)
        assert score(field.viterbi(em)) == pytest.approx(score(best))


def test_one_line_of_many_words(scanner):
    text = "word " * 40000 + "password: " + "aB3" * 6
    assert any(text[a:z] == "aB3" * 6 for a, z in scanner.spans(text))
