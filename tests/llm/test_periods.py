"""Runs of words against a search over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import WORD, documents, empty, prose, rows

from palestra.llm import periods


def runs_of(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(key, text):
    words = planted(key, WORD.findall(text or ""))
    runs = runs_of(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def more():
    rng = random.Random(5)
    found = []
    for k in range(60):
        letters = "abcdefgh"[: rng.randrange(1, 9)]
        words = [rng.choice(letters) for _ in range(rng.randrange(90))]
        found.append((1000 + k, " ".join(words), None, None, None))
    repeated = "x y z " * 4 + prose(3, 40) + " q w" * 9 + " " + prose(4, 30) + " q w" * 5
    return [*found, (2000, repeated, None, None, None), (2000, repeated, None, None, None), (-7, "a b " * 50, None, None, None)]


def test_digests_equal_brute_force(spark):
    data = rows(more())
    got = sorted((tuple(r) for r in periods.digests(documents(spark, data)).collect()), key=repr)
    assert got == sorted((expected(k, t) for k, t, *_ in data), key=repr)
    assert sum(r[1] > 1 for r in got) >= 2 and any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got)
    assert periods.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("cover,pairs_at_once", [(4, 7), (16, 100), (64, 1 << 20)])
def test_runs_of_many_texts(cover, pairs_at_once):
    rng = random.Random(cover)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([0, 1, 5, 6, 7, 20, 100, 300])
            words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
            if n > 20 and rng.random() < 0.7:
                a, p = rng.randrange(n), rng.randrange(1, n // 3)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(np.array(words, np.int64))
        got = list(zip(*(x.tolist() for x in periods.runs_of(texts, cover, pairs_at_once))))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in runs_of(t.tolist())]


@pytest.mark.parametrize("cover", [4, 9, 16, 64])
def test_lce_of_all_places(cover):
    rng = random.Random(7)
    sequence = [rng.randrange(2) for _ in range(70)] + [0, 1] * 60 + [2] + [0, 1] * 50 + [3]
    table = periods.SampledSuffixes(np.array(sequence), cover)
    one, two = np.array([(i, j) for i in range(len(sequence)) for j in range(len(sequence)) if i < j]).T
    for i, j, n in zip(one, two, table.lce(one, two)):
        assert n == next((k for k in range(len(sequence) - j) if sequence[i + k] != sequence[j + k]), len(sequence) - j)


def test_long_texts_stay_within_chunks():
    for words in (np.zeros(30_000, np.int64), np.tile(np.arange(997), 30)):
        _, start, length, period = periods.runs_of([words])
        assert (start.tolist(), length.tolist()) == ([0], [len(words)]) and period.tolist() == [len(set(words.tolist()))]


def test_texts_without_repeats(spark):
    found = {r["doc_id"]: r for r in periods.collapsed(documents(spark, rows(more()))).collect()}
    assert found[14]["collapsed"] == "aaaa" and found[14]["runs"] == [(0, 300, 1)] and found[4]["collapsed"] == ""
    assert found[12]["collapsed"] == "same line here again"
