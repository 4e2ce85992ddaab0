"""The k most similar vectors of every vector: partitions, anisotropic four-bit codes, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weaveline.functions.vectors import usable
from weaveline.scratch import bounded_broadcast, hot_keys, materialize, spread

#: The index is fitted on so many distinct vectors, chosen by hash, or on four a partition if these are more, but never on more than MOST_TRAIN; every vector is indexed.
TRAIN_ROWS, MOST_TRAIN = 20_000, 200_000
#: Of these, the code books see at most so many.
BOOK_ROWS = 8_000
#: Groups of so many distinct vectors are scanned whole.
WHOLE_ROWS = 4_096
#: Queries of a task, codes of a block, and codes a task scans.
ASK_ROWS, BLOCK_ROWS, CHUNK_ROWS = 16_384, 4_096, 524_288
#: Queries whose tables are added together.
TILE = 64
#: Rough scores a query whose codes go to exact scoring, with all that tie with the last.
RERANK = 40
#: Anisotropic threshold: residuals count by how they change scores of at least this cosine.
THRESHOLD = 0.2
#: Numbers of a score matrix that the driver or an index task holds at once.
_CELLS_AT_ONCE = 8_000_000


def unit_rows(vectors) -> np.ndarray:
    out = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def nearest_cells(x: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) numbers of the centroids of highest product, best first."""
    step, out = max(1, _CELLS_AT_ONCE // len(centroids)), []
    for i in range(0, len(x), step):
        score = x[i : i + step].astype(np.float32) @ centroids.T
        some = np.argpartition(-score, most - 1, axis=1)[:, :most]
        out.append(np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.int32) if out else np.empty((0, most), np.int32)


def train_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty cell takes a row that fits its centroid badly."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        at = nearest_cells(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        if len(empty):
            total[empty] = x[np.argsort(np.einsum("nd,nd->n", x, c[at]))[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def cell_places(centroids: np.ndarray) -> np.ndarray:
    """A place in a line for every cell, near cells near each other: halves along the main axis, again and again."""
    order: list[int] = []
    stack = [np.arange(len(centroids))]
    while stack:
        part = stack.pop()
        if len(part) < 3:
            order.extend(part.tolist())
            continue
        away = centroids[part] - centroids[part].mean(0)
        axis = np.linalg.svd(away, full_matrices=False)[2][0]
        part = part[np.argsort(away @ axis, kind="stable")]
        stack += [part[len(part) // 2 :], part[: len(part) // 2]]
    places = np.empty(len(centroids), np.int64)
    places[order] = np.arange(len(centroids))
    return places


class Quantizer:
    """Product codes of 16 centres a block of `width` numbers, fitted with a loss that weighs the residual along the vector more.

    The loss of a unit vector x with reconstruction y is |x - y|^2 + (eta - 1) <x - y, x>^2
    with eta = (d - 1) t^2 / (1 - t^2), t the score that matters.
    """

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta

    @staticmethod
    def fit(x: np.ndarray, width: int = 2, rounds: int = 6, threshold: float = THRESHOLD, seed: int = 11) -> "Quantizer":
        n, d = x.shape
        if d % width:
            raise ValueError("the dimension must be a multiple of the block width")
        rng, blocks = np.random.default_rng(seed), x.reshape(n, d // width, width)
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        books = blocks[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
        q = Quantizer(books, eta)
        codes = None
        for _ in range(rounds):
            codes = q.encode(x, codes)
            y = q.decode(codes).reshape(blocks.shape)
            along = ((blocks - y) * blocks).sum(2)  # each block's part of <x - y, x>
            total = along.sum(1)
            for m in range(blocks.shape[1]):
                b = blocks[:, m]
                rest = total - along[:, m] + (b * b).sum(1)
                left = np.zeros((16, width, width))
                right = np.zeros((16, width))
                np.add.at(left, codes[:, m], np.eye(width) + (eta - 1) * b[:, :, None] * b[:, None, :])
                np.add.at(right, codes[:, m], b * (1 + (eta - 1) * rest[:, None]))
                used = np.bincount(codes[:, m], minlength=16) > 0
                books[m, used] = np.linalg.solve(left[used], right[used][..., None])[..., 0]
                fresh = ((b - books[m][codes[:, m]]) * b).sum(1)
                total, along[:, m] = total - along[:, m] + fresh, fresh
        return q

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent over the blocks, from the nearest centres."""
        m, _, width = self.books.shape
        blocks = x.reshape(len(x), m, width)
        far = np.stack([((blocks[:, j, None, :] - self.books[j][None]) ** 2).sum(2) for j in range(m)])
        par = np.stack([(blocks[:, j] ** 2).sum(1)[:, None] - blocks[:, j] @ self.books[j].T for j in range(m)])
        codes = (far.argmin(2).T if codes is None else codes).astype(np.int64)
        rows = np.arange(len(x))
        total = sum(par[j][rows, codes[:, j]] for j in range(m))
        for _ in range(sweeps):
            for j in range(m):
                rest = total - par[j][rows, codes[:, j]]
                codes[:, j] = (far[j] + (self.eta - 1) * (par[j] + rest[:, None]) ** 2).argmin(1)
                total = rest + par[j][rows, codes[:, j]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(len(self.books))], axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes a code, 256, queries) sums of the two table entries that a byte of packed codes names.

        A query's table of a block has 16 entries, its products with the
        centres, scaled to one byte each by one factor a query.
        """
        m, _, width = self.books.shape
        products = np.einsum("qmw,mcw->mcq", queries.reshape(len(queries), m, width).astype(np.float32), self.books.astype(np.float32))
        products -= products.min(1, keepdims=True)
        small = np.round(products * (255 / np.maximum(products.max((0, 1)), 1e-30))).astype(np.uint8).astype(np.uint16)
        if m % 2:
            small = np.concatenate([small, np.zeros_like(small[:1])])
        return (small[1::2][:, :, None] + small[::2][:, None]).reshape(len(small) // 2, 256, len(queries))


def scan_codes(tables: np.ndarray, packed: np.ndarray, out: np.ndarray, rows: int = 2048) -> None:
    """Rough scores of packed codes into `out` (queries, codes): for each byte of the codes, the tables' entries are looked up and added for all queries at once."""
    spare = np.empty((rows, tables.shape[2]), np.uint16)
    for i in range(0, len(packed), rows):
        at = packed[i : i + rows].T.astype(np.intp)
        total, more = np.take(tables[0], at[0], axis=0), spare[: at.shape[1]]
        for j in range(1, len(tables)):
            np.take(tables[j], at[j], axis=0, out=more, mode="clip")
            total += more
        out[:, i : i + rows] = total.T


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    codes = codes.astype(np.uint8)
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def unpack_codes(packed: np.ndarray, blocks: int) -> np.ndarray:
    out = np.empty((len(packed), packed.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :blocks]


def nearest(
    vectors: DataFrame, key: str, vector: str, within: list[str], *, k: int = 5, dims: int = 96, probes: int | None = None, rerank: int = RERANK, train_rows: int = TRAIN_ROWS,
    book_rows: int = BOOK_ROWS, whole_rows: int = WHOLE_ROWS, ask_rows: int = ASK_ROWS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The k most similar vectors of every usable one with equal `within` columns: (key, neighbor, cosine, rank).

    Equal vectors form a class that is searched once and offers its k + 1
    smallest keys.  Each class is put into its nearest of about half the square
    root of n cells, with a four-bit code for every two numbers.  Queries of
    near cells of a group share a task, to which the codes of the cells they
    probe are sent (3 times the square root of the number of cells unless
    given; all cells for groups of up to `whole_rows`).  The task adds up each
    query's tables at the codes and keeps its best `rerank` and every code that
    ties with the last of them; then only the vectors that some query of the
    task kept are fetched and scored exactly.  A query that met fewer than k
    others, though its group has them, scans all its group's cells.

    Tasks are cut by blocks of queries and chunks of codes, so none grows with
    a hot cell and no vector is left out.  Of more than k vectors of one
    direction (to 1e-7 a number, so cosine 1 to 12 digits) one is searched, as
    the list is the same for all: their smallest keys.

    Centroids and code books are fitted on the driver on a sample by hash of at
    most 200,000 vectors; all vectors are indexed.  Beyond 10^10 vectors cells
    no longer grow in number.  Unusable vectors are neither asked nor found;
    null `within` values form a value of their own.  Ties go to the smaller
    key.  A vector whose group has fewer than k others gets as many as there are.
    """
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType
    rows = usable(vectors, vector, dims).select(
        F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"), F.xxhash64(F.to_json(F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(within)]))).alias("grp")
    )
    cls = ["grp", "h1", "h2"]
    members = materialize(rows.select("grp", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2"), "id"), "vector-members")
    top = members.withColumn("r", F.row_number().over(Window.partitionBy(*cls).orderBy("id"))).filter(F.col("r") <= k + 1)
    offers = materialize(top, "vector-offers")  # a class's smallest keys
    reps = offers.filter("r = 1").select(*cls, F.col("id").alias("rep"))
    n = reps.count()
    neighbors = T.StructType([T.StructField(key, key_type), T.StructField("neighbor", key_type), T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if n == 0:
        return spark.createDataFrame([], neighbors)
    copies, _ = bounded_broadcast(materialize(members.join(reps, cls).filter("id <> rep").select("id"), "vector-copies"))
    distinct = rows.join(copies, "id", "left_anti").withColumnRenamed("id", "rep")
    cells = max(1, round(n**0.5 / 2))
    wanted = min(MOST_TRAIN, max(train_rows, 4 * cells))
    drawn = distinct.filter(F.pmod(F.xxhash64("rep"), F.lit(max(1, n // wanted))) == 0).select("rep", "v")
    x = unit_rows(drawn.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(wanted).toPandas()["v"])
    if len(x) < 32:
        x = unit_rows(distinct.select("rep", "v").orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(wanted).toPandas()["v"])
    centroids = train_cells(x, min(cells, max(1, len(x) // 4)))
    cells, places, quantizer = len(centroids), cell_places(centroids), Quantizer.fit(x[:book_rows])
    probes = min(probes or int(np.ceil(3 * cells**0.5)), cells)

    indexed = T.StructType(
        [T.StructField("grp", T.LongType()), T.StructField("rep", key_type), T.StructField("near", T.ArrayType(T.IntegerType())), T.StructField("place", T.LongType())]
        + [T.StructField("direction", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("asked", T.BinaryType())]
    )

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                b = batch.iloc[i : i + 2000]
                u = unit_rows(b["v"])
                near = nearest_cells(u, centroids, probes)
                way = [xxhash.xxh3_64_intdigest(r.tobytes()) for r in np.round(u * 1e7).astype(np.int32)]
                asked = np.round(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)  # ranks don't depend on the scale
                yield pd.DataFrame(
                    {"grp": b["grp"].values, "rep": b["rep"].values, "near": list(near), "place": places[near[:, 0]], "direction": np.array(way, np.uint64).view(np.int64)}
                    | {"code": [r.tobytes() for r in pack_codes(quantizer.encode(u))], "asked": [r.tobytes() for r in asked]}
                )

    posts = materialize(spread(distinct, "rep").select("grp", "rep", "v").mapInPandas(index, indexed), "vector-index")
    sizes, _ = bounded_broadcast(materialize(posts.groupBy("grp").agg(F.count("*").alias("in_group")), "group-sizes"))
    shared, _ = bounded_broadcast(materialize(posts.groupBy("grp", "direction").agg(F.count("*").alias("c"), F.min("rep").alias("ask")).filter(F.col("c") > k).drop("c"), "directions"))
    part = F.floor(F.col("place") * F.ceil(F.col("in_group") / ask_rows) / cells).cast("int")
    placed = posts.join(sizes, "grp").join(shared, ["grp", "direction"], "left").withColumn("part", part).withColumn("cell", F.col("near")[0])
    asks = placed.filter(F.col("ask").isNull() | (F.col("ask") == F.col("rep"))).withColumn("whole", F.col("in_group") <= whole_rows).select("grp", "part", "rep", "near", "asked", "whole", "in_group")

    # codes in blocks: one row holds up to about `block_rows` of a cell, by key
    held = placed.select("grp", "cell", "rep", "code")
    counts = materialize(held.groupBy("grp", "cell").agg(F.count("*").alias("codes")), "cell-sizes")
    small_counts, _ = bounded_broadcast(counts)
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("codes") / block_rows).cast("int")).cast("int")
    blocks = held.join(small_counts, ["grp", "cell"]).withColumn("block", block).groupBy("grp", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("rep", "code"))).alias("x"))
    blocks = materialize(blocks.select("grp", "cell", "block", F.col("x.rep").alias("ids"), F.unhex(F.concat_ws("", F.transform("x.code", F.hex))).alias("codes")), "code-blocks")

    task = ["grp", "part", "ask_block", "chunk"]
    kept = T.StructType(
        [T.StructField("grp", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("ask_block", T.IntegerType()), T.StructField("rep", key_type)]
        + [T.StructField("in_group", T.LongType()), T.StructField("chunks", T.IntegerType()), T.StructField("others", T.ArrayType(key_type)), T.StructField("rough", T.ArrayType(T.IntegerType()))]
    )
    width = (dims // 2 + 1) // 2

    def scan(key: tuple, asked: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        """Each query's best codes of the chunk, and in a row without query all vectors that the task wants."""
        if not len(asked) or not len(codes):
            return pd.DataFrame(columns=kept.names)
        packed = [np.frombuffer(c, np.uint8).reshape(-1, width) for c in codes["codes"]]
        ids, at_cell = [np.asarray(i) for i in codes["ids"]], codes["cell"].to_numpy()
        near = [np.asarray(x) for x in asked["near"]]
        asked = asked.iloc[np.argsort([x[0] for x in near], kind="stable")]
        whole, found, rough, wanted = bool(asked["whole"].iloc[0]), [], [], [asked["rep"].to_numpy()]
        split = int(asked["chunks"].iloc[0]) > 1
        for i in range(0, len(asked), TILE):
            tile = asked.iloc[i : i + TILE]
            at = np.arange(len(at_cell)) if whole else np.flatnonzero(np.isin(at_cell, np.unique(np.concatenate([np.asarray(x) for x in tile["near"]]))))
            if not len(at):
                found += [ids[0][:0]] * len(tile)
                rough += [np.empty(0, np.int32)] * len(tile)
                continue
            tables = quantizer.tables(np.frombuffer(b"".join(tile["asked"]), np.int8).reshape(len(tile), dims))
            met = np.concatenate([packed[b] for b in at])
            scores, end = np.empty((len(tile), len(met)), np.uint16), len(met)
            scan_codes(tables, met, scores)
            cut = max(end - rerank, 0)
            least = np.partition(scores, cut, axis=1)[:, cut]
            q, c = np.divmod(np.flatnonzero(scores >= least[:, None]), end)
            others, ends = np.concatenate([ids[b] for b in at])[c], np.searchsorted(q, np.arange(1, len(tile)))
            found += np.split(others, ends)
            rough += np.split(scores[q, c].astype(np.int32), ends)
            wanted.append(pd.unique(others))
        head = {"grp": key[0], "part": key[1], "ask_block": key[2]}
        lists = pd.DataFrame({"rep": asked["rep"].to_numpy(), "in_group": asked["in_group"].to_numpy(), "chunks": asked["chunks"].to_numpy(), "others": found, "rough": rough if split else None})
        want = pd.DataFrame({"rep": [None], "in_group": 0, "chunks": lists["chunks"].iloc[0], "others": [pd.unique(np.concatenate(wanted))], "rough": None})
        return pd.concat([lists.astype({"rep": object}), want]).assign(**head)[kept.names]

    def survivors(asks: DataFrame, name: str) -> DataFrame:
        """`kept` rows of all queries."""
        near = asks.filter("not whole").select("grp", "part", F.explode("near").alias("cell")).distinct().join(counts, ["grp", "cell"])
        every = asks.filter("whole").select("grp", "part").distinct().join(small_counts, "grp")
        routes = materialize(near.select("grp", "part", "cell", "codes").unionByName(every.select("grp", "part", "cell", "codes")), f"{name}-routes")
        cuts = asks.groupBy("grp", "part").agg(F.ceil(F.count("*") / ask_rows).cast("int").alias("ask_blocks"))
        cuts, _ = bounded_broadcast(materialize(cuts.join(routes.groupBy("grp", "part").agg(F.ceil(F.sum("codes") / chunk_rows).cast("int").alias("chunks")), ["grp", "part"]), f"{name}-cuts"))
        routes, _ = bounded_broadcast(routes.drop("codes"))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        sent = blocks.join(routes, ["grp", "cell"]).join(cuts, ["grp", "part"]).withColumn("chunk", F.pmod(F.xxhash64("cell", "block"), F.col("chunks")).cast("int")).withColumn("ask_block", numbers("ask_blocks"))
        asked = asks.join(cuts, ["grp", "part"]).withColumn("ask_block", F.pmod(F.xxhash64("rep"), F.col("ask_blocks")).cast("int")).withColumn("chunk", numbers("chunks"))
        left = asked.select(*task, "rep", "near", "asked", "whole", "in_group", "chunks").groupBy(*task)
        lists = materialize(left.cogroup(sent.select(*task, "cell", "ids", "codes").groupBy(*task)).applyInPandas(scan, kept), name)
        if lists.filter("chunks > 1").limit(1).count():  # the best of all chunks, ties kept
            each = lists.filter("chunks > 1 and rep is not null").select(*[c for c in kept.names if c not in ("others", "rough")], F.explode(F.arrays_zip("others", "rough")).alias("x"))
            best = each.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.desc("x.rough")))).filter(F.col("r") <= rerank)
            merged = best.groupBy("grp", "part", "ask_block", "rep", "in_group", "chunks").agg(F.collect_list("x.others").alias("others"), F.lit(None).cast("array<int>").alias("rough"))
            lists = materialize(lists.filter("chunks = 1 or rep is null").unionByName(merged.select(*kept.names)), f"{name}-merged")
        return lists

    scored = T.StructType([T.StructField("rep", key_type), T.StructField("other", key_type), T.StructField("cosine", T.DoubleType())])

    def exact(key: tuple, lists: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        """The k best others of each query's list."""
        if not len(lists) or not len(fetched):
            return pd.DataFrame(columns=scored.names)
        fetched = fetched.sort_values("rep")
        ids = pd.Index(fetched["rep"])
        u = unit_rows(fetched["v"])
        mine, out = ids.get_indexer(lists["rep"]), []
        others = [np.asarray(x) for x in lists["others"]]
        sizes = np.array([len(x) for x in others])
        bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // 65_536, prepend=-1)).tolist() + [len(others)]
        for start, end in zip(bounds, bounds[1:]):
            if not sizes[start:end].sum():
                continue
            q, o = np.repeat(mine[start:end], sizes[start:end]), ids.get_indexer(np.concatenate(others[start:end]))
            q, o = q[q != o], o[q != o]
            cosine = np.concatenate([np.round(np.einsum("pd,pd->p", u[q[i : i + 65_536]], u[o[i : i + 65_536]]), 12) for i in range(0, len(q), 65_536)] or [np.empty(0)])
            order = np.lexsort((o, -cosine, q))
            q, o, cosine = q[order], o[order], cosine[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            top = place < k
            out.append(pd.DataFrame({"rep": fetched["rep"].to_numpy()[q[top]], "other": fetched["rep"].to_numpy()[o[top]], "cosine": cosine[top]}))
        return pd.concat(out) if out else pd.DataFrame(columns=scored.names)

    lists = survivors(asks, "kept-codes")
    short = lists.filter(F.col("rep").isNotNull() & (F.size("others") < F.least(F.lit(k + 1), "in_group"))).select("rep")
    if short.limit(1).count():
        again = survivors(materialize(asks.join(short, "rep", "left_semi").withColumn("whole", F.lit(True)), "short-lists"), "kept-codes-of-all-cells")
        lists = lists.join(short, "rep", "left_anti").unionByName(again.withColumn("part", -1 - F.col("part")))
    at = ["grp", "part", "ask_block"]
    wanted = lists.filter("rep is null").select(*at, F.explode("others").alias("rep")).distinct()
    wanted, _ = bounded_broadcast(materialize(wanted, "wanted"), 500_000)
    fetched = distinct.select("rep", "v").join(wanted, "rep").select(*at, "rep", "v")
    closest = lists.filter("rep is not null").select(*at, "rep", "others").groupBy(*at).cogroup(fetched.groupBy(*at)).applyInPandas(exact, scored)
    # from classes to keys: at most k classes of k + 1 keys and the class itself
    offer = materialize(offers.join(reps, cls).select("rep", "id"), "vector-offers-by-class")
    own = offer.select("rep", F.col("id").alias("neighbor"), F.lit(1.0).alias("cosine"))
    others = closest.join(offer.select(F.col("rep").alias("other"), F.col("id").alias("neighbor")), "other").select("rep", "neighbor", "cosine")
    ranked = own.unionByName(others).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbor"))).filter(F.col("r") <= k + 1).drop("r")
    lists = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbor"))).alias("list"))  # at most k + 1
    lent = placed.filter("ask is not null and ask <> rep").select("rep", "ask")
    lists = materialize(lists, "neighbor-lists")
    lists = lists.join(lent.select("rep"), "rep", "left_anti").unionByName(lent.join(lists.withColumnRenamed("rep", "ask"), "ask").select("rep", "list"))
    lists = lists.join(reps, "rep")
    hot = hot_keys(members.select(*cls), cls)
    salted = members.join(hot, cls, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    wide = lists.join(hot, cls, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return (
        salted.join(wide, [*cls, "salt"])
        .select("id", F.posexplode(F.slice(F.filter("list", lambda x: x["neighbor"] != F.col("id")), 1, k)).alias("i", "x"))
        .select(F.col("id").alias(key), F.col("x.neighbor").alias("neighbor"), (-F.col("x.far")).alias("cosine"), (F.col("i") + 1).alias("rank"))
    )


def similar_pairs(found: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (id_a, id_b), smaller first, of which one is a neighbour of the other with at least `least` cosine."""
    return found.filter(F.col("cosine") >= least).select(F.least(key, "neighbor").alias("id_a"), F.greatest(key, "neighbor").alias("id_b")).distinct()
