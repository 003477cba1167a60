"""The secret field that the query uses learns nothing from a table: its quality, and that rows don't change each other's spans."""

import itertools
import random
import string

import numpy as np

from pagesift.llm import secrets
from pagesift.llm.common import table
from pagesift.llm.crf import LinearChain

SF = "/root/testdata/sf0.01"
FORMS = [("machine host login anna password ", ""), ("deploy --token ", " --force"), ('<add key="DbPassword" value="', '"/>'), ('"pass": "', '"'), ("the password for the server is ", " as we said")]


def planted(documents, n=30):
    rng = random.Random(29)
    for before, after in FORMS:
        for _ in range(n):
            value, doc = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(14, 24))), rng.choice(documents)
            at = len(doc) + 1 + len(before)
            yield f"{doc}\n{before}{value}{after}\n", at, at + len(value)


def test_spans_of_a_text_depend_on_that_text_alone(spark):
    documents = [r.text or "" for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    rows = [(i, text) for i, (text, _, _) in enumerate(planted(documents))]
    others = [(-1 - i, text) for i, text in enumerate(documents)]
    spans = lambda some: {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(some, "doc_id long, text string"), digest=True).where("doc_id >= 0").collect()}
    few, many = spans(rows[::7]), spans(rows + others)
    assert many.items() >= few.items() and len(many) == len(rows)
    found = sum(any(int(a) <= s and z <= int(b) for _, a, b in (x.split(":") for x in many[i].split(",") if x)) for i, (_, s, z) in enumerate(planted(documents)))
    assert found >= 0.85 * len(rows)


def test_few_findings_in_texts_without_secrets(spark):
    scanner, wrong = secrets.Scanner(secrets.field()), 0
    documents = [r.text or "" for r in table(spark, SF, "documents").collect()]
    for text in documents:
        base = secrets.base_spans(text)
        wrong += sum(not any(s < z and a < e for s, e, _ in base) for a, z in scanner.spans(text))
    assert wrong <= len(documents) // 500


def test_viterbi_takes_the_first_of_equal_tags():
    field = LinearChain(1)
    for em in itertools.product([0.0, 1.0], repeat=6):
        em = np.array(em).reshape(2, 3)
        tr, st = field.transitions + field.forbidden, field.start + field.not_first
        at = st + em[0]
        last = (at[:, None] + tr).max(0) + em[1]
        want = int(last.argmax())
        assert field.viterbi(em) == [int((at[:, None] + tr).argmax(0)[want]), want]
