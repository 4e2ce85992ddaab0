import numpy as np
import pytest

from weaveline.llm import neighbors as K


def _frame(spark, ids, vectors, groups):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], g, "m", "x") for i, v, g in zip(ids, vectors, groups)], "id long, embedding array<float>, view_name string, model string, rep string")


def _brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -row))[:k]] for i, row in zip(ids, s)}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 96))
    x = (centres[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 96))).astype(np.float32)
    x *= rng.uniform(0.1, 30, (1500, 1)).astype(np.float32)
    ids = np.arange(1500)
    got = {}
    for r in K.nearest(_frame(spark, ids, x, ["v"] * 1500), "id", "embedding", ["view_name", "model"]).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    want = _brute(ids, x.astype(float), 5)
    assert all(len(v) == 5 for v in got.values()) and len(got) == 1500
    assert np.mean([len(set(got[i]) & set(w)) / 5 for i, w in want.items()]) >= 0.9


def test_copies_ties_groups_and_unusable_vectors(spark):
    e = np.eye(96, dtype=np.float32)
    vectors = [e[0]] * 8 + [e[0] + 0.1 * e[1], e[1], e[0]] + [None, np.zeros(96), np.full(96, np.nan), e[0][:50], np.full(96, np.inf)]
    groups = ["v"] * 10 + [None] + ["v"] * 5
    rows = K.nearest(_frame(spark, range(16), vectors, groups), "id", "embedding", ["view_name", "model"]).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got[0] == [1, 2, 3, 4, 5] and got[7] == [0, 1, 2, 3, 4]
    assert got[8] == [0, 1, 2, 3, 4] and got[9] == [8, 0, 1, 2, 3]
    assert set(got) == set(range(10))  # row 10 is alone in its group, the rest unusable
    pairs = {(r["id_a"], r["id_b"]) for r in K.similar_pairs(K.nearest(_frame(spark, range(16), vectors, groups), "id", "embedding", ["view_name", "model"]), "id", 0.85).collect()}
    assert (0, 1) in pairs and (0, 8) in pairs and not any(9 in p for p in pairs) and all(a < b for a, b in pairs)


def test_blocks_of_a_hot_partition_change_nothing(spark):
    rng = np.random.default_rng(2)
    x = (np.ones(96) + 0.3 * rng.normal(size=(300, 96))).astype(np.float32)
    frame = _frame(spark, range(300), x, ["v"] * 300)
    whole, cut = ({(r["id"], r["neighbor"]) for r in K.nearest(frame, "id", "embedding", ["view_name"], probes=99, rerank=300, block_rows=b).collect()} for b in (4096, 37))
    assert whole == cut == {(i, j) for i, near in _brute(np.arange(300), x.astype(float), 5).items() for j in near}


def test_one_direction_at_many_lengths_loses_no_neighbour(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=96)
    x = np.concatenate([hot * rng.uniform(0.1, 30, (400, 1)), hot + 0.2 * rng.normal(size=(40, 96)), rng.normal(size=(760, 96))]).astype(np.float32)
    ids = rng.permutation(1200)
    for block_rows in (K.BLOCK_ROWS, 90):
        got = {}
        for r in K.nearest(_frame(spark, ids, x, ["v"] * 1200), "id", "embedding", ["view_name"], block_rows=block_rows).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["neighbor"])
        unit = K.unit_rows(x)
        cosines = np.round(unit @ unit.T, 12)
        np.fill_diagonal(cosines, -9)
        want = {i: [ids[j] for j in np.lexsort((ids, -row))[:5]] for i, row in zip(ids, cosines)}
        assert all(got[i] == want[i] for i in ids[:400])
        near = ids[400:440]
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in near]) >= 0.95


def test_codes_round_trip_and_parallel_residual_shrinks():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 16, (50, 7))
    assert (K.unpack_codes(K.pack_codes(codes), 7) == codes).all()
    x = K.unit_rows(rng.normal(size=(3000, 96)))
    along = lambda q: float((((x - q.decode(q.encode(x))) * x).sum(1) ** 2).mean())
    assert along(K.Quantizer.fit(x, threshold=0.2)) < 0.8 * along(K.Quantizer.fit(x, threshold=1e-6))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>, view_name string")
    assert K.nearest(empty, "id", "embedding", ["view_name"]).collect() == []


def test_a_small_group_beside_a_large_one_has_whole_lists(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6012, 96)).astype(np.float32)
    groups = ["large"] * 6000 + ["small"] * 12
    got = {}
    for r in K.nearest(_frame(spark, range(6012), x, groups), "id", "embedding", ["view_name"]).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert all(len(got[i]) == 5 for i in range(6012))
    want = _brute(np.arange(6000, 6012), x[6000:].astype(float), 5)
    assert all(set(got[i]) == set(w) for i, w in want.items())


def test_chunks_of_codes_and_blocks_of_queries_change_nothing(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 96)).astype(np.float32)
    frame = _frame(spark, range(400), x, ["v"] * 400)
    run = lambda **o: {(r["id"], r["neighbor"]) for r in K.nearest(frame, "id", "embedding", ["view_name"], rerank=40, **o).collect()}
    assert run(whole_rows=1, probes=99) == run(whole_rows=1, probes=99, ask_rows=60, block_rows=20, chunk_rows=50) == run()


def test_queries_that_meet_too_few_scan_all_cells(spark):
    rng = np.random.default_rng(9)
    lone = rng.normal(size=(900, 96))
    x = np.concatenate([lone, -10 * np.ones((3, 96)) + 0.1 * rng.normal(size=(3, 96))]).astype(np.float32)
    got = {}
    for r in K.nearest(_frame(spark, range(903), x, ["v"] * 903), "id", "embedding", ["view_name"], whole_rows=1, probes=1).collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert all(len(got[i]) == 5 for i in range(903))


def test_table_scan_ranks_as_the_decoded_products():
    rng = np.random.default_rng(10)
    x = K.unit_rows(rng.normal(size=(3000, 96)))
    q = K.Quantizer.fit(x)
    packed, scores = K.pack_codes(q.encode(x)), np.empty((40, 3000), np.uint16)
    K.scan_codes(q.tables(x[:40]), packed, scores)
    true = x[:40] @ q.decode(q.encode(x)).T
    assert all(np.corrcoef(a, b)[0, 1] > 0.999 for a, b in zip(scores, true))


def test_string_keys_and_ties_by_key(spark):
    e = np.eye(96)
    rows = [(f"k{i}", [float(y) for y in e[0] * (i + 1)], "v") for i in (7, 3, 5, 1, 9, 2, 8)] + [("z", [float(y) for y in e[1]], "v")]
    got = {}
    for r in K.nearest(spark.createDataFrame(rows, "id string, embedding array<float>, view_name string"), "id", "embedding", ["view_name"], k=3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got["k9"] == ["k1", "k2", "k3"] and got["k2"] == ["k1", "k3", "k5"] and got["z"] == ["k1", "k2", "k3"]
