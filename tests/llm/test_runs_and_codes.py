"""Runs of words and vector codes against plain searches."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import runs, veccodes


def plain_runs(w, exponent=4, least=6):
    found, n = {}, len(w)
    for p in range(1, n):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)  # the smallest period comes first
            i = j
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_all_short_words():
    for n in range(1, 12):
        for w in itertools.product(range(2), repeat=n):
            assert runs.runs_of(list(w)) == plain_runs(w)
            assert runs.runs_of(list(w), 3, 3) == plain_runs(w, 3, 3)


def test_stretches_lose_no_run():
    rnd = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(3):
            n, k = rnd.randrange(90), rnd.choice((1, 2, 3, 9, 30))
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.7:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(3, 10)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        assert runs.runs_of_texts(texts) == [plain_runs(w) for w in texts]


def test_words_are_matched_once():
    """Comparisons of words grow with the words, whatever they repeat."""
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    nested = [0]
    for c in range(1, 7):
        nested = nested * 4 + [c]
    rnd = random.Random(2)
    for w in (fib[-1], fib[-1][::-1], nested, nested[::-1], [0, 1] * 9000, [0] * 20_000, [rnd.randrange(2) for _ in range(500)] * 40, ([0] * 300 + [1]) * 60):
        made = 0

        def counted(w, k, i, l):
            nonlocal made
            while i + l < len(w):
                made += 1
                if w[k + l] != w[i + l]:
                    break
                l += 1
            return l

        assert len(runs.lyndon_edges(w, counted)) <= 2 * len(w) and made <= 2 * len(w)


DOCS = [(1, "a b " * 9 + "c"), (None, "x x x x x x x y"), (None, None), (2, ""), (2, " \t\n"), (3, "é ü " * 7), (4, "one two three"), (4, "one two three"), (0, "q " * 20_000), *((k, " ".join(random.Random(k).choices("abcdef", k=k * 7))) for k in range(10, 60))]


def test_runs_of_a_table(spark):
    docs = spark.createDataFrame([(*r, 7, "z") for r in DOCS], "doc_id long, text string, `n.x` long, runs string").repartition(3)
    got = runs.op12_periodic_runs(spark, docs).collect()
    want = []
    for doc_id, text in DOCS:
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        found = [(0, len(w), 1)] if len(w) == 20_000 else plain_runs(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert Counter(map(tuple, got)) == Counter(want)
    kept = runs.periodic_runs(docs)
    assert kept.columns == ["doc_id", "text", "n.x", "n_words", "runs", "collapsed"] and kept.where("doc_id = 1").first()["collapsed"] == "a b c"
    assert runs.op12_periodic_runs(spark, docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, exponent=2)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, tuple(int(np.floor(4096 * float(x))) for x in v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(part(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v in kept:
            for p in range(parts):
                groups[p].setdefault(near(v, p)[1], []).append(part(v, p))
        for p in range(parts):
            for k, g in groups[p].items():
                books[p][k] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    return Counter((i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in kept), books


def test_codes_of_a_table(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + rnd.normal(size=16) * 0.3).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, [0.5] * 16), (None, rows[7][1]), (None, None), (-4, [1.0] * 15 + [None]), (-3, [float("nan")] * 16), (-2, [float("inf")] * 16), (-6, [])]
    rows += [(k, [0.25 * (k % 3), -0.25] * 8) for k in range(400, 440)]  # ties
    table = spark.createDataFrame([(*r, None if (r[0] or 0) % 4 == 0 else (r[0] or 0) % 4, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    found = veccodes.compress(table)
    want, books = plain_codes(rows)
    assert Counter(map(tuple, found.rows.select("vec_id", "code", "error").collect())) == want
    assert [[tuple(e) for e in b] for b in found.codebooks] == books
    assert 0 < found.scans[0] <= 8 * sum(want.values()) and sum(found.scans[1:]) < 0.7 * 5 * found.scans[0]
    got = veccodes.op13_vector_codes(spark, table).collect()
    sums = Counter()
    for r in found.rows.collect():
        sums[r["label"]] += r["error"]
    assert {r["label_error"] for r in got} == set(sums.values()) and len(got) == sum(want.values())


def test_codes_of_few_and_large_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert veccodes.op13_vector_codes(spark, spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    few = [(3, [1e30] * 8, 1), (1, [0.0] * 8, None), (2, [1.0] * 9, 1), (4, [-1e30] * 8, 1)]
    got = {r["vec_id"]: r for r in veccodes.op13_vector_codes(spark, spark.createDataFrame(few, kind)).collect()}
    assert sorted(got) == [1, 3, 4] and [got[k]["error"] for k in (1, 3, 4)] == [0, 0, 0] and len({r["code"] for r in got.values()}) == 3
