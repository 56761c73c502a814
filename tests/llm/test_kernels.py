from __future__ import annotations

import random
import re

import numpy as np
import regex

from corpusloom.llm import kernels as K


def test_words_of_both_kinds():
    texts = ["The Quick-brown fox 42!", "", "İstanbul Kelvin", "été ﬁn 漢字かな १२ x̂", " \0 a\0b "]
    w = K.Words(texts)
    plain = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    assert [w.bound[i + 1] - w.bound[i] for i in range(len(texts))] == [len(x) for x in plain]
    flat = [x for p in plain for x in p]
    by = {}
    for word, h in zip(flat, w.hash):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    u = K.Words(texts, unicode=True)
    plain = [regex.findall(r"[\p{L}\p{N}]+", t.lower()) for t in texts]
    assert [u.bound[i + 1] - u.bound[i] for i in range(len(texts))] == [len(x) for x in plain]


def test_shingles_do_not_cross_texts():
    sets = [a for a, _ in K.shingle_sets(["a b c d", "a b c", "", "a b", "b c d e a b c"])]
    assert [len(a) for a in sets] == [2, 1, 0, 0, 5]
    assert sets[1][0] in sets[0] and sets[1][0] in sets[4]


def test_window_minima_depend_on_the_window_alone():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 6, 400).astype(np.uint64) << np.uint64(40)
    for w in (1, 2, 7, 60, 400):
        got = K.window_minima(x, w)
        for i in range(len(x) - w + 1):
            v = x[i : i + w]
            assert got[i] == i + np.flatnonzero(v == v.min())[-1]
    assert len(K.window_minima(x, 401)) == 0


def test_blocks_cover_everything():
    rnd = random.Random(2)
    texts = ["x" * rnd.randrange(50) for _ in range(100)] + ["y" * 500]
    got = list(K.blocks(texts, 100))
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert list(K.blocks([])) == []
