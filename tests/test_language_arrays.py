"""Languages are scored by arrays: no work in Python for each word, and the same guesses as a plain loop over trigrams."""

import random
import sys

import pytest

from pagesift.functions import language as N


def plain(model, words):
    n = range(len(model.languages))
    grams = [model.weights.get(f" {w} "[i : i + 3], (N.FLOOR,) * len(n)) for w in words.split() for i in range(len(w))]
    if not grams:
        return None
    score, known = [sum(g[i] for g in grams) for i in n], [sum(g[i] > N.FLOOR for g in grams) for i in n]
    best, *rest = sorted(n, key=lambda i: (-score[i], model.languages[i]))
    return {"language": model.languages[best], "confidence": known[best] * 100 // len(grams) / 100, "reliable": not rest or score[best] - score[rest[0]] >= N.LEAD * len(grams)}


#: The last alphabet has too many characters for a table of all their trigrams.
@pytest.mark.parametrize("alphabet", ["abc", "abcdé\U0001d4b3ß", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))])
@pytest.mark.parametrize(("block", "step"), [(5, 9), (100, 50), (1 << 20, 1 << 19)])
def test_guesses_are_those_of_a_plain_loop(monkeypatch, alphabet, block, step):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "STEP", step)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
    for languages in (("fr",), ("fr", "de"), ("en", "de", "fr", "es")):
        weights = {f" {w} "[i : i + 3]: tuple(rng.choice([N.FLOOR, -rng.randint(1000, 9000)]) for _ in languages) for w in (word() for _ in range(100)) for i in range(len(w))}
        model = N.LanguageModel(languages, weights)
        texts = [rng.choice([None, "", " ".join(word() + rng.choice(["", "z"]) for _ in range(rng.randint(1, 30)))]) for _ in range(40)]
        assert model.guesses(texts).to_pylist() == [plain(model, t or "") for t in texts]


def test_no_call_for_each_different_word():
    model, calls = N.LanguageModel(("en",), {" ab": (-5,), "abc": (-7,)}), []
    words = lambda n: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(n))
    model.guess("abc")
    for text in (words(100), words(10_000)):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        model.guess(text)
        sys.setprofile(None)
        calls.append(len(seen))
    assert calls[1] < 2 * calls[0]
