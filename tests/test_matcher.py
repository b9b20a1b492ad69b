"""Many values in one text: against looking for them one by one, with the automaton and without its library."""

import builtins
import random
import time

import pytest

from credtrace.functions import matcher


@pytest.fixture(params=[True, False])
def library(request, monkeypatch):
    """With the library, and as if it were missing."""
    if not request.param:
        real = builtins.__import__
        monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "ahocorasick" else real(name, *a, **k))
    return request.param


def one_by_one(values, text):
    """Characters that some place of a value hides."""
    hidden = set()
    for v in set(values) - {""}:
        at = text.find(v)
        while at >= 0:
            hidden |= set(range(at, at + len(v)) if len(v) <= 8 else range(at + 4, at + len(v) - 4))
            at = text.find(v, at + 1)
    return "".join("*" if k in hidden and c != "\n" else c for k, c in enumerate(text))


def test_masks_against_one_by_one(library):
    rng = random.Random(1)
    for _ in range(200):
        lines = ["".join(rng.choice("abcABé ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        text = "\n".join(lines)
        values = [text[a:a + rng.choice([1, 3, 9, 12, 20])] for a in rng.choices(range(max(len(text), 1)), k=rng.randint(0, 8))] + ["", "zzzz"]
        assert "\n".join(matcher.masked(values, lines)) == one_by_one(values, text)


def test_overlapping_and_nested_values(library):
    assert matcher.masked(["abcdefghijkl", "ijklmnopqrst", "abcd"], ["abcdefghijklmnopqrst"]) == ["********ijkl****qrst"]
    assert matcher.masked(["x" * 600], ["y" + "x" * 601]) == ["yxxxx" + "*" * 593 + "xxxx"]
    assert matcher.masked(["line one\nline two"], ["a line one", "line two b"]) == ["a line****", "**** two b"]
    assert matcher.masked([], ["a", ""]) == ["a", ""]


def test_holders_against_one_by_one(library):
    rng = random.Random(2)
    for _ in range(200):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        values = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(6)] + texts[:2]
        want = [next((k for k, t in enumerate(texts) if v in t and v != t), None) if v else None for v in values]
        assert matcher.holders(values, texts) == want


def test_cost_does_not_grow_with_the_product():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    values = [word(24) for _ in range(20000)]
    lines = [f'key = "{rng.choice(values)}" {word(20)}' for _ in range(20000)]  # over a mebibyte
    spent = {}
    for n in (2000, 20000):
        started = time.time()
        clean = matcher.masked(values[:n], lines)
        spent[n] = time.time() - started
    assert sum("*" * 16 in x for x in clean) == len(lines)
    assert spent[20000] < 6 * spent[2000] + 1
    started = time.time()
    texts = [f"{word(9)}{v}{word(9)}" for v in values[:5000]]
    assert matcher.holders(values[:5000], texts) == list(range(5000)) and time.time() - started < 5
