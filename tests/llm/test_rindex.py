"""Fragments and their index: what goes before the index holds no repeat, and the index finds all others."""

import random

import numpy as np
import pytest

from geoflow.llm import rindex


def _text(rng, n, letters="abcdefghijklmnopqrstuvwxyz "):
    return "".join(rng.choice(letters) for _ in range(n)).encode()


def _rows(texts, window):
    """(key, content, bytes) of the distinct fragments of `texts`, by key."""
    which, start, n, key, content, _ = rindex.fragments(texts, window)
    rows = {(k, c): texts[w][s : s + m + window - 1] for w, s, m, k, c in zip(which.tolist(), start.tolist(), n.tolist(), key.view("int64").tolist(), content.view("int64").tolist(), strict=True)}
    return [(k, c, data) for (k, c), data in sorted(rows.items())]


def _brute(rows, window):
    """Window starts of each fragment that also start elsewhere among the fragments of its key."""
    seen = {}
    for key, content, data in rows:
        for i in range(len(data) - window + 1):
            seen.setdefault((key, data[i : i + window]), []).append((content, i))
    hits = {}
    for (key, _), places in seen.items():
        for content, i in places if len(places) > 1 else []:
            hits.setdefault((key, content), []).append(i)
    return {k: sorted(v) for k, v in hits.items()}


def test_a_gram_of_several_texts_is_not_one_that_comes_twice_in_a_run():
    rng = random.Random(1)
    phrase = _text(rng, 40)
    apart = [_text(rng, 300) + phrase + _text(rng, 300) for _ in range(20)]
    assert not rindex.fragments(apart)[5].any()
    assert rindex.fragments([(_text(rng, 60) * 20)[:1000]])[5].all()  # a period shorter than the window


@pytest.mark.parametrize("pack", [1, 1 << 16])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "é𝄞a"])
def test_indexed_fragments_equal_brute_force(letters, pack):
    rng = random.Random(2)
    for window in (17, 20, 33, 60):
        shared = [_text(rng, 3 * window, letters) for _ in range(3)]
        texts = [rng.choice(shared)[rng.randrange(20) : rng.randrange(window, 3 * window)] + _text(rng, rng.randrange(80), letters) + rng.choice(shared)[: rng.randrange(3 * window)] for _ in range(30)]
        rows = _rows([*texts, b"z" * 90, b"", b"ab" * 60], window)
        got = {(k, c): [i for a, b in spans for i in range(a, b + 1)] for k, c, spans in rindex.indexed(rows, window, pack=pack)}
        assert got == _brute(rows, window)
        assert got


def test_fragments_that_share_a_phrase_only_are_not_indexed(monkeypatch):
    rng = random.Random(3)
    phrase, passage = _text(rng, 60), _text(rng, 260)
    texts = [_text(rng, 300) + phrase + _text(rng, 300) for _ in range(200)] + [_text(rng, 100) + passage + _text(rng, 100) for _ in range(2)]
    rows = _rows(texts, 200)
    keys = [r[0] for r in rows]
    rows = [r for r in rows if keys.count(r[0]) > 1]
    sizes = []

    class Counted(rindex.RunIndex):
        def __init__(self, strings):
            sizes.append(sum(map(len, strings)))
            super().__init__(strings)

    monkeypatch.setattr(rindex, "RunIndex", Counted)
    got = {(k, c) for k, c, _ in rindex.indexed(rows)}
    assert got == set(_brute(rows, 200))
    assert got
    assert sum(sizes) < 0.05 * sum(len(r[2]) for r in rows)


def test_match_lengths_from_a_least_one_on():
    rng = random.Random(4)
    index = rindex.RunIndex([_text(rng, 200, "ab"), _text(rng, 50, "ab") + b"abba" * 20, b"", b"abba" * 30])
    every, long = index.matching(), index.matching(20)
    assert np.array_equal(every >= 20, long >= 20)
    assert np.array_equal(every[every >= 20], long[every >= 20])
