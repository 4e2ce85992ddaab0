import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weaveline.llm import packing as P


def _check(histogram, capacity):
    plan = P.plan_best_fit(histogram, capacity)
    used, ranks = {}, {}
    for length, rank, n, first, offset in plan:
        for i in range(n):
            assert rank + i not in ranks.setdefault(length, set())
            ranks[length].add(rank + i)
            used.setdefault(first + i, []).append((offset, offset + length))
    for length, n in histogram.items():
        assert ranks[length] == set(range(n))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert set(used) == set(range(len(used)))
    return len(used)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_item_once_without_overlap(histogram):
    rooms = []  # best fit item by item
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 40) - length)
    assert _check(histogram, 40) == len(rooms)


def test_plan_is_tight_on_many_sizes():
    rng = random.Random(0)
    histogram = {}
    for _ in range(50_000):
        n = min(int(rng.expovariate(1 / 400)) + 1, 2048)
        histogram[n] = histogram.get(n, 0) + 1
    assert sum(k * v for k, v in histogram.items()) / (_check(histogram, 2048) * 2048) > 0.999


def test_a_length_over_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        P.plan_best_fit({41: 1}, 40)


def test_tables(spark):
    rows = [(i, "word " * (i % 7 * 30 + 1)) for i in range(200)] + [(900, None), (901, ""), (902, "big word " * 200), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank")
    for rank_rows in (500_000, 7):
        got = P.pack(df, "doc_id", "text", capacity=256, rank_rows=rank_rows).collect()
        enc = P.load_encoding()
        assert sorted({r["doc_id"] for r in got}) == sorted({k for k, t in rows if t is not None})
        spans = {}
        for r in got:
            size = r["token_end"] - r["token_start"]
            if r["doc_id"] == 901:
                assert size == 0 and r["container_id"] is None
                continue
            spans.setdefault(r["container_id"], []).append((r["container_offset"], r["container_offset"] + size))
            if r["n_pieces"] > 1:
                assert r["doc_id"] == 902
        for s in spans.values():
            s.sort()
            assert s[-1][1] <= 256 and all(x[1] <= y[0] for x, y in zip(s, s[1:]))
        big = sorted((r["token_start"], r["token_end"]) for r in got if r["doc_id"] == 902)
        assert big[0][0] == 0 and big[-1][1] == len(enc.encode_ordinary("big word " * 200)) and all(x[1] == y[0] for x, y in zip(big, big[1:]))
        report = P.fill_report(P.pack(df, "doc_id", "text", capacity=256), 256).first()
        assert report["fullest"] <= 256 and report["utilization"] > 0.95


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(empty, "doc_id", "text").collect() == []
    assert P.fill_report(P.pack(empty, "doc_id", "text")).first()["n_containers"] == 0
