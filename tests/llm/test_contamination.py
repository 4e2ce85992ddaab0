import random

import numpy as np
import pytest

from weaveline.llm import contamination as C


def test_words():
    assert C.words_of("Ｆｏｏ_bar ﬁne so­ft ze​ro X²") == ["foo", "bar", "fine", "soft", "zero", "x2"]


def test_winnowing_keeps_one_of_every_window_and_depends_on_it_alone():
    h = np.array([5, 3, 3, 9, 1, 7, 7, 7], np.uint64)
    kept = C.winnow(h, 3)
    assert all(any(i <= k < i + 3 for k in kept) for i in range(6))
    assert list(C.winnow(np.array([4, 2, 2], np.uint64), 5)) == [2]
    assert len(C.winnow(np.empty(0, np.uint64), 3)) == 0


def test_any_shared_run_of_twelve_words_shares_a_fingerprint():
    rng = random.Random(0)
    for _ in range(300):
        run = [rng.randint(0, 50) for _ in range(12)]
        docs = [[rng.randint(0, 50) for _ in range(rng.randint(0, 30))] + run + [rng.randint(0, 50) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        a, b = (set(g[C.winnow(g, 5)]) for g in (C.gram_hashes(np.array(d, np.uint64) * np.uint64(2**57 + 11), 8) for d in docs))
        assert a & b


def _brute(a, b, n):
    wa, wb = C.words_of(a), C.words_of(b)
    grams = {tuple(wa[i : i + n]) for i in range(len(wa) - n + 1)}
    return any(tuple(wb[i : i + n]) in grams for i in range(len(wb) - n + 1))


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_leaks_equal_brute_force(spark, broadcast_rows):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(20)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = []
    for i in range(120):
        words = items[i % 20][1].split()
        k = rng.choice([0, 8, 11, 12, 13, 20, 30])
        at = rng.randint(0, 30 - k)
        docs.append((i, (say(15) + "\n\n" + " ".join(words[at : at + k]).upper() + ", " + say(15))))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (503, "long " * 50_000 + items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as fp")
    t = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc", "4 as salt")
    got = {(r["doc_id"], r["item_id"]): r["run_words"] for r in C.leaks(d, t, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text", broadcast_rows=broadcast_rows).collect()}
    want = {(i, j) for i, a in docs if a for j, b in items if b and _brute(a, b, 12)}
    assert set(got) == want and len(want) > 20
    assert got[(503, 0)] == 30
    report = {r["item_id"]: r["n_docs"] for r in C.leaked_items(spark.createDataFrame([(*k, v) for k, v in got.items()], "doc_id long, item_id long, run_words int"), "item_id").collect()}
    assert report[0] == len([1 for _, j in want if j == 0])


def test_empty_sides(spark):
    d, t = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert C.leaks(d, t, doc_key="doc_id", doc_text="text", item_key="item_id", item_text="text").collect() == []
