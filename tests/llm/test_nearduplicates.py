import random
import re

import numpy as np
import pytest

from weaveline.llm import nearduplicates as N


def _texts(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(60, 200))] for _ in range(n)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for rate in (0.01, 0.04, 0.08, 0.2):
            copy = [rng.choice(vocab) if rng.random() < rate else w for w in words]
            out.append(" ".join(copy).upper() if rate == 0.01 else " ".join(copy))
    return out


def _sets(text, width, least):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= least else None


def _brute(rows, width, threshold, least):
    sets = [(k, key, _sets(t, width, least)) for k, key, t in rows if t is not None]
    sets = [x for x in sets if x[2]]
    return {(k, a, b) for i, (k, a, s) in enumerate(sets) for k2, b, t in sets[i + 1 :] if k == k2 and len(s & t) >= threshold * len(s | t)}


def _found(spark, rows, **options):
    df = spark.createDataFrame(rows, "kind string, key long, text string").repartition(3)
    links, members = N.near_duplicates(df, **options)
    return {(r["kind"], r["key_a"], r["key_b"]) for r in N.expanded_pairs(links, members).collect()}


def test_pairs_equal_brute_force(spark):
    texts = _texts()
    rows = [("document" if i % 2 else "chunk", i, t) for i, t in enumerate(texts + texts[:40])]
    got, want = _found(spark, rows, width=3, threshold=0.6, measure="set", least_words=50), _brute(rows, 3, 0.6, 50)
    assert got <= want
    assert len(got) >= 0.98 * len(want) > 50


def test_repeated_texts_and_pairs_over_common_shingles_are_found(spark):
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randint(0, 10**7)}" for _ in range(n)]
    rows = []
    for i in range(20):
        text = words(100)
        rows += [("chunk", 2 * i, " ".join(text)), ("chunk", 2 * i + 1, " ".join(text * (5, 10, 20, 40)[i % 4]))]
    common = words(130)  # a third of the documents begins alike: two of a pair have 0.61 to 0.64 of their shingles in common
    for i in range(60):
        rows.append(("document", i, " ".join(common + words(rng.choice((37, 38, 39))))))
    rows += [("document", 1000 + i, " ".join(words(60))) for i in range(120)]
    want = _brute(rows, 3, 0.6, 50)
    got = _found(spark, rows, width=3, threshold=0.6, measure="set", least_words=50)
    assert got <= want and len(want) > 1700
    assert {x for x in want if x[0] == "chunk"} <= got
    assert len(got) >= 0.99 * len(want)


def test_detection_at_the_threshold_does_not_depend_on_size():
    rng = np.random.default_rng(6)
    for both, own in ((36, 12), (150, 50)):  # 0.6 of the shingles in common
        sets = []
        for _ in range(1500):
            x = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
            sets += [x[: both + own], np.concatenate([x[:both], x[both + own :]])]
        logs = np.zeros(sum(map(len, sets)), np.float32)
        bands = N.band_hashes(N.Sampler().sign(np.concatenate(sets), logs, np.repeat(np.arange(len(sets)), both + own), len(sets)))
        assert (bands[::2] == bands[1::2]).any(1).mean() >= 0.99


def test_wide_buckets_lose_nothing(spark):
    rng = random.Random(3)
    head = [f"h{i}" for i in range(150)]
    rows = [("document", i, " ".join(head + [f"t{rng.randint(0, 10**6)}" for _ in range(10)])) for i in range(60)] + [("document", 99, None), ("document", 100, "short")]
    want = _brute(rows, 3, 0.6, 50)
    assert len(want) > 1000
    assert _found(spark, rows, width=3, threshold=0.6, measure="set", least_words=50, wide_bucket=8, block=16) == want


def test_a_third_of_the_rows_are_copies(spark):
    text = " ".join(f"a{i}" for i in range(80))
    rows = [("chunk", i, text) for i in range(30)] + [("chunk", 100 + i, " ".join(f"b{i}x{j}" for j in range(80))) for i in range(60)]
    links, members = N.near_duplicates(spark.createDataFrame(rows, "kind string, key long, text string"), width=5, threshold=0.8)
    assert links.count() == 0
    assert {r["rep"] for r in members.collect() if r["key"] < 30} == {0}


def test_weighted_similarity_is_one_for_equal_and_falls_with_edits():
    known = N.WordHash()
    a, b = (N.shingles(t, known, 3, 1) for t in ("a b c d e f g h", "a b c d e f g z"))
    idf = np.full(N.SKETCH, 0.7, np.float32)
    assert N._weighted(*a, *a, idf) == (1.0, pytest.approx(1.0))
    s, w = N._weighted(*a, *b, idf)
    assert s == pytest.approx(5 / 7) and w == pytest.approx(5 / 7, abs=1e-6)


def test_collision_rate_of_samples_is_the_weighted_similarity():
    rng = np.random.default_rng(1)
    sampler = N.Sampler(passes=64, bins=16)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:280], rng.integers(0, 2**63, 120, dtype=np.uint64)])
    weights = {int(x): rng.uniform(0.5, 1.0) for x in np.union1d(a, b)}
    wa, wb = (np.log([weights[int(x)] for x in side]).astype(np.float32) for side in (a, b))
    s = sampler.sign(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 400), 2)
    inter = sum(weights[int(x)] for x in a[:280])
    want = inter / (np.exp(wa).sum() + np.exp(wb).sum() - inter)
    assert abs((s[0] == s[1]).mean() - want) < 0.06


def test_empty_table(spark):
    links, members = N.near_duplicates(spark.createDataFrame([], "kind string, key long, text string"), width=3, threshold=0.6)
    assert links.count() == 0 and members.count() == 0 and N.expanded_pairs(links, members).count() == 0


def test_groups(spark):
    base = [f"a{i}" for i in range(100)]
    near = base[:95] + ["z"] * 5
    rows = [("chunk", 7, " ".join(base)), ("chunk", 3, " ".join(near)), ("chunk", 9, " ".join(base)), ("chunk", 1, " ".join(f"q{i}" for i in range(100))), ("document", 3, " ".join(base))]
    got = {(r["kind"], r["key"]): (r["group_key"], r["rep"], r["n_links"]) for r in N.groups(*N.near_duplicates(spark.createDataFrame(rows, "kind string, key long, text string"), width=3, threshold=0.6)).collect()}
    assert got == {("chunk", 7): (3, 7, 1), ("chunk", 9): (3, 7, 1), ("chunk", 3): (3, 3, 1), ("chunk", 1): (1, 1, 0), ("document", 3): (3, 3, 0)}


def test_copies_in_parts_are_all_paired(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 4)
    base = [f"a{i}" for i in range(100)]
    rows = [("chunk", i, " ".join(base)) for i in range(13)] + [("chunk", 20 + i, " ".join(base[:95] + ["z"] * 5)) for i in range(9)]
    assert _found(spark, rows, width=3, threshold=0.6, measure="set", least_words=50) == _brute(rows, 3, 0.6, 50)


def test_detection_at_the_threshold_under_the_worst_weights():
    rng = np.random.default_rng(6)
    logs, sets, sizes = [], [], []
    low = np.log(np.float32(N.SET_FLOOR))
    for _ in range(1500):  # 0.6 of the shingles in common, all of the lowest weight, the others of the highest
        x = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets += [x[:48], np.concatenate([x[:36], x[48:]])]
        logs += [np.repeat([low, 0], [36, 12])] * 2
    bands = N.band_hashes(N.Sampler().sign(np.concatenate(sets), np.concatenate(logs).astype(np.float32), np.repeat(np.arange(3000), 48), 3000))
    assert (bands[::2] == bands[1::2]).any(1).mean() >= 0.99
