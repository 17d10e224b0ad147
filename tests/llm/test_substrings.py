"""Repeated windows against a plain count of all of them."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import substrings


def plain(texts, window):
    words = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n, window):
    """Passages of about a window in other surroundings, near copies, copies, a line and a passage in very many texts,
    repeats inside a text."""
    rnd = random.Random(seed)
    text = lambda k, v=400: [f"w{rnd.randrange(v)}" for _ in range(k)]
    shared = [text(rnd.randint(window - 3, 2 * window)) for _ in range(8)]
    out = []
    for i in range(n):
        w = text(rnd.randint(0, 3 * window))
        kind = i % 7
        if kind == 1:
            p = rnd.choice(shared)
            a = rnd.randrange(len(p) // 2)
            w = w + p[a : a + rnd.randint(window - 4, window + 9)] + text(rnd.randint(0, 9))
        elif kind == 2 and out:
            w = list(out[rnd.randrange(len(out))])
            if w and rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = "Changed"
        elif kind == 3:
            w = shared[0][:window] + w + shared[0][:window]
        elif kind == 4:
            w = w + ["x"] * rnd.randrange(2 * window)
        elif kind == 5:
            w = w + text(2, 3) * rnd.randrange(window)
        out.append(w)
    return [rnd.choice((" ", "\n", " \t ")).join(w) for w in out]


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 24, 200):
        assert substrings.smallest(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_equal_windows_lie_at_one_place_of_one_seed():
    rnd = np.random.default_rng(4)
    words = rnd.integers(0, 3, 3000).astype(np.uint64)
    first, width, seeds, names = substrings.blocks(words, 9, 4)
    assert first[0] == 0 and (first[1:] == (first + width)[:-1]).all() and first[-1] + width[-1] == len(words) - 8 and width.max() <= 6
    seen = {}
    for f, n, s in zip(first, width, seeds, strict=True):
        for x in range(f, f + n):
            assert seen.setdefault(tuple(words[x : x + 9].tolist()), int(s)) == int(s)


@pytest.mark.parametrize("window,seed", [(35, 12), (12, 5)])
def test_repeats_of_a_table(spark, window, seed):
    texts = [*corpus(window, 200, window), None, "", " \n", "É " * 50, "é " * 50, "one " * window]
    docs = spark.createDataFrame([(None if i % 50 == 0 else i // 2, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, `kept.x` string").repartition(6)
    got = substrings.without_repeats(docs, window, seed).collect()
    want = Counter((None if i % 50 == 0 else i // 2, *r) for i, r in enumerate(plain(texts, window)))
    assert sum(n for (*_, n, _), _ in [(k, 0) for k in want]) > 1000
    digest = lambda r: (r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["repeats"]), hashlib.sha256(r["kept"].encode()).hexdigest())
    assert Counter(map(digest, got)) == want
    if window == 35:
        assert Counter(map(tuple, substrings.op11_substrings(spark, docs).collect())) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.op11_substrings(spark, docs).count() == 0
