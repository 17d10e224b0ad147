"""The n-gram join against brute force: families, null and repeated ids, large signatures."""

import random
from collections import Counter

import numpy as np
import pytest

from loomwright.llm import ngramjoin
from loomwright.llm.textnum import shingle_set


def plain(rows):
    """Row to the least known doc_id that links reach; equal sets and similar sets link."""
    sets = [{tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [(t or "").lower().split()]]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * len(sets[i] | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


def family(r, n, words, edits):
    base = [f"w{r.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    r = random.Random(11)
    texts = family(r, 60, 80, 4) + family(r, 30, 300, 14) + family(r, 20, 12, 1)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {' '.join(f'q{r.randrange(10**6)}' for _ in range(60))}" for _ in range(40)]  # a shared passage, similarity 1/3
    texts += [t.upper() for t in texts[:9]] + [None, "", " \n ", "one two", "ONE  two", "one two three"]
    rows = list(enumerate(texts, 1))
    rows += [(5, rows[100][1]), (5, rows[4][1]), (None, rows[70][1]), (None, rows[2][1]), (None, "quite alone in here and null"), (None, None)]
    pair = family(r, 2, 200, 2)
    rows += [(None, pair[0]), (None, pair[0]), (900, pair[1])]  # one side of a link is held by null ids only
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("most", "bucket", "cell"), [(2048, 1 << 20, 4096), (8, 100, 64), (3, 40, 10)])
def test_join_equals_brute_force_on_families(spark, most, bucket, cell):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    got = ngramjoin.jaccard_join(docs, most=most, bucket_size=bucket, cell=cell).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == plain(rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, of_text string").repartition(5)
    got = ngramjoin.one_of_each(docs)
    assert got.columns == docs.columns
    got = got.collect()
    groups = {}
    joined = ngramjoin.jaccard_join(docs).collect()
    for x in joined:
        if x["root"] is not None:
            groups.setdefault(x["root"], []).append(x["doc_id"])
    best = [min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()]
    without = [i for i, t in rows if not (t or "").split()]
    assert Counter(r["doc_id"] for r in got) == Counter(best + without)


def test_sketches_lose_no_similar_pair():
    r = np.random.default_rng(5)
    for n in (1, 9, 100, 257, 1030, 5000):
        union = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        kept = []
        for _ in range(10):
            cut = r.permutation(n)[: int(0.2 * n)]
            split = int(r.integers(0, len(cut) + 1))
            kept += [np.delete(union, cut[:split]), np.delete(union, cut[split:])]
        s = ngramjoin.Sketches(np.array([len(x) for x in kept]), [ngramjoin.sketch(x) for x in kept])
        i, j = np.arange(0, 20, 2), np.arange(1, 20, 2)
        assert s.possible(i, j)[0].tolist() == i.tolist()
    far = [np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)) for _ in range(2)]
    s = ngramjoin.Sketches(np.array([300, 300]), [ngramjoin.sketch(x) for x in far])
    assert len(s.possible(np.array([0]), np.array([1]))[0]) == 0


def test_saturated_sketches_coarsen_exactly():
    counts = np.random.default_rng(2).integers(0, 7, (5, 256))
    fine = np.minimum(counts, 3).astype(np.uint8)
    assert (ngramjoin._coarser(fine, 64) == np.minimum(counts.reshape(5, 64, 4).sum(2), 3)).all()
    s = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 200, dtype=np.uint64) << np.uint64(1))
    held = ngramjoin.Sketches(np.array([200]), [ngramjoin.sketch(s)]).counts[256][0]
    assert (held == np.minimum(np.bincount((s >> np.uint64(56)).astype(int), minlength=256), 3)).all()
    assert len(shingle_set("a b c d e f")) == 2


def test_only_loose_nodes_of_a_signature_are_paired(spark):
    def block(sig, no, members):
        return members[0] if sig is None else min(members), sig, no, np.array(members, dtype=np.int64).tobytes()

    linked, mixed, alone = list(range(100, 140)), list(range(200, 260)), list(range(300, 320))
    rows = [block(7, k, linked[10 * k : 10 * k + 10]) for k in range(4)] + [block(8, k, mixed[10 * k : 10 * k + 10]) for k in range(6)]
    rows += [block(9, k, alone[10 * k : 10 * k + 10]) for k in range(2)] + [block(None, None, [1, 2, 3])]
    blocks = spark.createDataFrame(rows, "hub long, sig long, no int, members binary")
    far = [203, 219, 231, 244, 258]  # not in the component of the rest of their signature
    roots = [(x, 100) for x in linked] + [(x, 200) for x in mixed if x not in far]
    found = ngramjoin.cells(blocks, spark.createDataFrame(roots, "node long, root long"), 8).collect()
    held = {}
    for r in found:
        held.setdefault((r["sig"], r["loose"]), []).append(np.frombuffer(r["members"], np.int64).tolist())
    assert sorted(held) == [(8, False), (8, True), (9, False), (9, True)]  # all of 7 are linked
    assert held[8, True] == [far] and sorted(sum(held[8, False], [])) == [x for x in mixed if x not in far]
    assert sorted(sum(held[9, True] + held[9, False], [])) == alone and len(sum(held[9, False], [])) == 1
    assert {r["hub"] for r in found if r["sig"] == 8} == {200}
