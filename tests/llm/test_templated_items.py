"""Benchmark items that share most of their text: equal to the plain distance, in bounded time."""

import random
import time

import pytest

from zetasky.llm import decontam

WORDS = ["alpha", "beta", "gamma", "x", "yz", "omega", "the", "of", "12", "question", "answer", "日本", "é"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i, way = rng.randrange(len(chars)), rng.random()
        if way < 0.3:
            chars[i] = rng.choice("abcxyz ")
        elif way < 0.6:
            chars.insert(i, rng.choice("abcxyz "))
        elif len(chars) > 1:
            del chars[i]
    return "".join(chars)


def plain(items, text, rate):
    held, found = decontam.normalise(text), {}
    for i, raw in items:
        if item := decontam.normalise(raw):
            distance = decontam.MyersMatcher(item).distance(held)
            if distance <= int(rate * len(item)):
                found[i] = min(distance, found.get(i, distance))
    return found


@pytest.mark.parametrize("pack", [1, 60, 10**6])
@pytest.mark.parametrize("rate", [0.05, 0.12])
def test_shared_pieces_equal_plain_distances(monkeypatch, pack, rate):
    monkeypatch.setattr(decontam, "PACK_CHARS", pack)
    rng, hits = random.Random(pack + int(100 * rate)), 0
    for _ in range(120):
        base = sentence(rng, rng.randint(5, 25))
        items = [(rng.randrange(9), edited(rng, base, rng.randint(0, 4)) if rng.random() < 0.7 else sentence(rng, rng.randint(1, 20))) for _ in range(rng.randint(1, 12))]
        text = " ".join(rng.choice([sentence(rng, rng.randint(1, 20)), edited(rng, rng.choice(items)[1], rng.randint(0, 6)), base]) for _ in range(rng.randint(1, 6)))
        want = plain(items, text, rate)
        hits += len(want)
        assert decontam.ItemMatcher(items, rate).find(text) == want
    assert hits > 100


def test_a_thousand_items_of_one_template():
    rng = random.Random(1)
    form = "What is the value of the function at point {} when the input grows without bound and the constant term equals {} in the given ring of integers modulo a prime number used in the standard test suite?"
    items = [(i, form.format(1000 + i, 7 * i)) for i in range(1000)]
    matcher = decontam.ItemMatcher(items, 0.05)
    text = " ".join(form.format(rng.randrange(10**4), rng.randrange(10**4)) for _ in range(60))
    began = time.process_time()
    found = matcher.find(text)
    assert time.process_time() - began < 30 and len(found) == 1000
    for i in range(0, 1000, 97):
        assert found[i] == plain([items[i]], text, 0.05)[i]
