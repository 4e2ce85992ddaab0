"""Queueing and scheduling: first-in-first-out with windows, other policies a queue at a time."""

from __future__ import annotations

import heapq
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fifo(jobs: DataFrame) -> DataFrame:
    """(queue, job, arrival, size, completion) of one server a queue, in order of (arrival, job).

    The recursion completion = max(arrival, previous) + size is a running
    maximum of arrival less the work before, plus the work up to and with the job.
    """
    run = Window.partitionBy("queue").orderBy("arrival", "job").rowsBetween(Window.unboundedPreceding, 0)
    w = jobs.select("queue", "job", "arrival", "size", F.sum("size").over(run).alias("work"))
    return w.withColumn("completion", F.max(F.col("arrival") - (F.col("work") - F.col("size"))).over(run) + F.col("work")).drop("work")


def nearest_rank(values: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles by rank ceil(p n), a column a share, from running counts of distinct values."""
    c = values.groupBy(by, value).agg(F.count("*").alias("c"))
    run = c.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    return run.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("n")), F.col(value))).alias(f"p{round(p * 100)}") for p in shares])


def policy(jobs: DataFrame, name: str, quantum: int = 1) -> DataFrame:
    """(queue, job, completion) under `sjf` (shortest job), `srpt` (shortest rest, preemptive) or `rr` (turns of `quantum`); a queue's jobs are one simulation."""
    if name not in ("sjf", "srpt", "rr"):
        raise ValueError(f"unknown policy {name}")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        todo = g.sort_values(["arrival", "job"])[["arrival", "job", "size"]].to_numpy().tolist()
        done, now, i, ready = {}, 0, 0, []
        turn = 0
        while i < len(todo) or ready:
            if not ready:
                now = max(now, todo[i][0])
            while i < len(todo) and todo[i][0] <= now:
                arrival, job, size = todo[i]
                heapq.heappush(ready, ((turn if name == "rr" else size), arrival, job, size))
                turn += 1
                i += 1
            _, arrival, job, rest = heapq.heappop(ready)
            nxt = todo[i][0] if i < len(todo) else None
            step = rest if name == "sjf" or (name == "srpt" and (nxt is None or now + rest <= nxt)) else min(rest, quantum) if name == "rr" else nxt - now
            now += step
            if step >= rest:
                done[job] = now
                continue
            if name == "rr":
                while i < len(todo) and todo[i][0] <= now:
                    heapq.heappush(ready, (turn, todo[i][0], todo[i][1], todo[i][2]))
                    turn += 1
                    i += 1
            heapq.heappush(ready, ((turn if name == "rr" else rest - step), arrival, job, rest - step))
            turn += 1
        return pd.DataFrame({"queue": g["queue"].iloc[0], "job": list(done), "completion": list(done.values())})

    q, j = jobs.schema["queue"].dataType.simpleString(), jobs.schema["job"].dataType.simpleString()
    return jobs.groupBy("queue").applyInPandas(run, f"queue {q}, job {j}, completion long")


def deficit_round_robin(sizes: list[list[int]], quantum: int, rounds: int) -> list[int]:
    """Bytes sent of each flow of packet sizes when every flow gains `quantum` a round and sends what its credit covers; an emptied flow loses its credit."""
    at, credit, sent = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    for _ in range(rounds):
        if all(a == len(s) for a, s in zip(at, sizes)):
            break
        for f, packets in enumerate(sizes):
            credit[f] += quantum
            while at[f] < len(packets) and packets[at[f]] <= credit[f]:
                credit[f] -= packets[at[f]]
                sent[f] += packets[at[f]]
                at[f] += 1
            if at[f] == len(packets):
                credit[f] = 0
    return sent


def flows_by_deficit(packets: DataFrame, quantum: int, rounds: int) -> DataFrame:
    """(queue, flow, sent): `deficit_round_robin` of each queue's flows; `packets` is (queue, flow, packet, size), in order of `packet`."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        flows = [(flow, f.sort_values("packet")["size"].astype(int).tolist()) for flow, f in g.groupby("flow", sort=True)]
        sent = deficit_round_robin([sizes for _, sizes in flows], quantum, rounds)
        return pd.DataFrame({"queue": g["queue"].iloc[0], "flow": [f for f, _ in flows], "sent": sent})

    q, f = (packets.schema[c].dataType.simpleString() for c in ("queue", "flow"))
    return packets.groupBy("queue").applyInPandas(run, f"queue {q}, flow {f}, sent long")


def admitted(jobs: DataFrame, room: int) -> DataFrame:
    """(queue, job, admitted, completion) of one server a queue that turns away a job when `room` others wait or run; in order of (arrival, job)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ends: list[int] = []
        first, rows = 0, []
        for arrival, job, size in g.sort_values(["arrival", "job"])[["arrival", "job", "size"]].itertuples(index=False):
            while first < len(ends) and ends[first] <= arrival:
                first += 1
            if len(ends) - first >= room:
                rows.append((g["queue"].iloc[0], job, False, None))
            else:
                ends.append(max(arrival, ends[-1] if ends else arrival) + size)
                rows.append((g["queue"].iloc[0], job, True, ends[-1]))
        return pd.DataFrame(rows, columns=["queue", "job", "admitted", "completion"]).astype({"completion": "Int64"})

    q, j = jobs.schema["queue"].dataType.simpleString(), jobs.schema["job"].dataType.simpleString()
    return jobs.groupBy("queue").applyInPandas(run, f"queue {q}, job {j}, admitted boolean, completion long")


def hedged(calls: DataFrame, share: float = 0.95) -> DataFrame:
    """(call, latency): a second request goes out after the `share` quantile (nearest rank) of first latencies, and the earlier answer counts; `calls` is (call, first, second)."""
    after = nearest_rank(calls.select(F.lit(1).alias("all"), "first"), "all", "first", (share,)).select(F.col(f"p{round(share * 100)}").alias("after"))
    slow = F.col("first") > F.col("after")
    return calls.join(F.broadcast(after)).select("call", F.when(slow, F.least("first", F.col("after") + F.col("second"))).otherwise(F.col("first")).alias("latency"))  # one row


def batched(requests: DataFrame, most: int, wait: int, fixed: int, each: int) -> DataFrame:
    """(queue, request, batch, completion): a server takes up to `most` requests once the batch is full or its first has waited `wait`; a batch of n takes `fixed` + n * `each`."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        todo = g.sort_values(["arrival", "request"])[["arrival", "request"]].to_numpy().tolist()
        rows, i, free, number = [], 0, 0, 0
        while i < len(todo):
            limit = todo[i][0] + wait
            full = todo[i + most - 1][0] if i + most <= len(todo) else limit
            begin, n = max(free, min(limit, full)), 1
            while n < most and i + n < len(todo) and todo[i + n][0] <= begin:
                n += 1
            free = begin + fixed + n * each
            rows += [(g["queue"].iloc[0], r, number, free) for _, r in todo[i : i + n]]
            i, number = i + n, number + 1
        return pd.DataFrame(rows, columns=["queue", "request", "batch", "completion"])

    q, r = (requests.schema[c].dataType.simpleString() for c in ("queue", "request"))
    return requests.groupBy("queue").applyInPandas(run, f"queue {q}, request {r}, batch int, completion long")


def stealing(depth: int, workers: int, seed: int = 0) -> tuple[int, int]:
    """(steps, tasks) of a binary recursion tree of fib(`depth`) on `workers` that take their newest task, or else the oldest of a random other."""
    rng = random.Random(seed)
    queues: list[list[int]] = [[depth], *[[] for _ in range(workers - 1)]]
    steps = tasks = 0
    while any(queues):
        taken = []
        for w in range(workers):
            others = [] if queues[w] else [v for v in range(workers) if queues[v]]
            if queues[w]:
                taken.append((w, queues[w].pop()))
            elif others:
                taken.append((w, queues[rng.choice(others)].pop(0)))
        for w, n in taken:
            tasks += 1
            queues[w] += [n - 1, n - 2] if n >= 2 else []
        steps += 1
    return steps, tasks


def mesh_latency(side: int, load: float, cycles: int, seed: int = 0) -> tuple[float, int]:
    """(mean cycles, packets) from source to target on a `side` x `side` mesh: each node starts a packet a cycle with probability `load`, packets go along the row, then the column, and a link carries one a cycle, the oldest first."""
    rng = random.Random(seed)
    moving: list[list[int]] = []  # [born, row, column, target row, target column]
    total = arrived = 0
    for now in range(cycles):
        for r in range(side):
            for c in range(side):
                if rng.random() < load:
                    to = (r * side + c + rng.randrange(1, side * side)) % (side * side)  # another node
                    moving.append([now, r, c, to // side, to % side])
        used, left = set(), []
        for p in sorted(moving, key=lambda p: p[0]):
            born, r, c, tr, tc = p
            to = (r, c + (1 if tc > c else -1)) if c != tc else (r + (1 if tr > r else -1), c) if r != tr else (r, c)
            if to == (r, c):
                total, arrived = total + now - born, arrived + 1
                continue
            if ((r, c), to) not in used:
                used.add(((r, c), to))
                p[1], p[2] = to
            left.append(p)
        moving = left
    return (total / arrived if arrived else 0.0), arrived
