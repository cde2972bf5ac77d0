"""Exact top-k inner products by a Voronoi join: pivots, group summaries, bounded replication, local search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import cut

#: Pivots are about twice the root of the number of rows, in these bounds, and hold so many numbers at most.
PIVOTS = (16, 4_096)
PIVOT_NUMBERS = 1 << 22
#: Rows of a data block and of a query block; a task meets one of each.
DATA_BLOCK = 32_768
QUERY_BLOCK = 65_536
#: Data blocks that smaller tables are dealt to as well, so that more than one task works.
LEAST_BLOCKS = 8
#: Rows of the table of needed groups that are broadcast (a row has 40 bytes); more are joined by shuffle.
BROADCAST_NEEDS = 200_000
#: Numbers of one array of a step.
STEP = 1 << 21
#: Components whose 256-fold isn't below this take no part; floats never get there.
LARGEST = 2.0**500
LONG = float(2**63)


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components floor(256 * x), exact in doubles; rows that are null or hold null or non-finite components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * 256.0)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    # floor gives longs; from 2**52 on every double is whole
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def at_most(data: DataFrame, k: int) -> DataFrame:
    """data (vec_id, v) with equal rows k times at most: more can't be among k answers. Only ids that come more than k times are looked at."""
    often = cut(data.groupBy("vec_id").count().where(F.col("count") > k).select("vec_id"))
    if not often.limit(1).count():
        return data
    equal = data.join(often, "vec_id", "left_semi").groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    kept = equal.select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.least("n", F.lit(k)).cast("int")))).select("vec_id", "v")
    return cut(data.join(often, "vec_id", "left_anti").unionByName(kept))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, shorter ones padded with zeros."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < np.diff(ends)[:, None]] = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return out


def unpacked(rows: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows)).reshape(-1, width)


def steps(rows: int, numbers: int) -> Iterator[slice]:
    """Slices of the rows, so many that each has about STEP numbers."""
    each = max(1, STEP // max(1, numbers))
    return (slice(i, min(rows, i + each)) for i in range(0, rows, each))


def dealt(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each group's first block and number of blocks, and the number of all: small neighbours share one, large groups are split."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    at, filled = 0, 0
    for j, n in enumerate(counts.tolist()):
        if filled and filled + n > size:
            at, filled = at + 1, 0
        first[j], parts[j] = at, max(1, -(-n // size))
        filled += n
        if parts[j] > 1:
            at, filled = at + int(parts[j]), 0
    return first, parts, at + 1


def placed(rows: DataFrame, pivots: np.ndarray, extra: str) -> DataFrame:
    """rows (extra, v) with v as binary doubles, and cell, far, norm: the nearest pivot, the distance from it, the length."""
    width, squares = pivots.shape[1], (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.num_rows, max(len(pivots), width)):
                rows = batch.slice(part.start, part.stop - part.start)
                x = matrix(rows.column("v"), width)
                at = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
                new = [pa.array(at, pa.int32()), pa.array(np.linalg.norm(x - pivots[at], axis=1)), pa.array(np.linalg.norm(x, axis=1)), pa.array([r.tobytes() for r in x], pa.binary())]
                names = [n for n in rows.schema.names if n != "v"]
                yield pa.record_batch([*(rows.column(n) for n in names), *new], names=[*names, "cell", "far", "norm", "v"])

    return rows.mapInArrow(run, f"{extra}, cell int, far double, norm double, v binary")


@dataclass
class Summary:
    """What is known of the groups: rows, largest distance from the pivot, largest length, and the k rows nearest to the pivot."""

    count: np.ndarray
    far: np.ndarray
    norm: np.ndarray
    near_far: np.ndarray
    near_id: np.ndarray


def summary(grouped: DataFrame, groups: int, k: int) -> Summary:
    """The groups' summaries: taken by partition, then by group; k rows a group reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far, norm = np.zeros(groups, np.int64), np.zeros(groups), np.zeros(groups)
        cell, near, ids = np.empty(0, np.int32), np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            c, f = batch.column("cell").to_numpy(), batch.column("far").to_numpy()
            count += np.bincount(c, minlength=groups)
            np.maximum.at(far, c, f)
            np.maximum.at(norm, c, batch.column("norm").to_numpy())
            cell, near, ids = np.concatenate((cell, c)), np.concatenate((near, f)), np.concatenate((ids, batch.column("vec_id").to_numpy()))
            order = np.lexsort((ids, near, cell))
            cell, near, ids = cell[order], near[order], ids[order]
            kept = np.arange(len(cell)) - np.searchsorted(cell, cell) < k
            cell, near, ids = cell[kept], near[kept], ids[kept]
        first = np.searchsorted(cell, cell) == np.arange(len(cell))
        yield pa.record_batch([pa.array(cell), pa.array(np.where(first, count[cell], 0)), pa.array(far[cell]), pa.array(norm[cell]), pa.array(near), pa.array(ids)], names=["cell", "n", "far", "norm", "near", "vec_id"])

    parts = grouped.select("vec_id", "cell", "far", "norm").mapInArrow(run, "cell int, n long, far double, norm double, near double, vec_id long")
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("near", "vec_id"))), 1, k)
    out = Summary(np.zeros(groups, np.int64), np.zeros(groups), np.zeros(groups), np.full((groups, k), np.inf), np.zeros((groups, k), np.int64))
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), nearest.alias("nearest")).toLocalIterator():
        c = r["cell"]
        out.count[c], out.far[c], out.norm[c] = r["n"], r["far"], r["norm"]
        for i, (f, v) in enumerate(r["nearest"]):
            out.near_far[c, i], out.near_id[c, i] = f, v
    return out


def bounds(q: np.ndarray, own: np.ndarray, home: np.ndarray, pivots: np.ndarray, known: Summary, k: int) -> tuple[np.ndarray, ...]:
    """(needed, low, high, length) for each query and group.

    A group can hold one of the query's k best only where needed, and there only rows that are low to
    high from their pivot and at least as long as length. A row x at distance f from its pivot p scores
    at least q.p - |q| f, so the k-th best of such bounds over the summaries' rows is a score t that
    the answer doesn't fall below. Rows of a group can't reach t if q.p + |q| f, or |q| |x|, or by
    2 q.x = |q|^2 + |x|^2 - |q - x|^2 the distance |q - x| says so; that distance is at least the
    difference of those from p, and at least that to the plane between p and the query's own pivot.
    All bounds are widened by more than rounding can be.
    """
    score = q @ pivots.T
    length = np.linalg.norm(q, axis=1)[:, None]
    at = np.linalg.norm(pivots, axis=1)[None, :]
    least = score[:, :, None] - length[:, :, None] * known.near_far[None, :, :]
    least = np.where((known.near_id[None, :, :] == own[:, None, None]) | ~np.isfinite(least), -np.inf, least).reshape(len(q), -1)
    t = np.partition(least, -k, axis=1)[:, -k][:, None] if least.shape[1] >= k else np.full((len(q), 1), -np.inf)
    t = np.where(t <= -LONG, -np.inf, np.minimum(t, LONG))  # scores are held to a long's range
    scale = length + at + known.far + known.norm
    t = t - 1 - 1e-9 * length * scale
    apart = np.sqrt(np.maximum(0, length**2 - 2 * score + at**2))
    spare = length**2 + known.norm**2 - 2 * t
    room = np.sqrt(np.maximum(0, spare)) + 1e-6 * scale
    with np.errstate(divide="ignore", invalid="ignore"):
        by_score = np.where(length > 0, (t - score) / length, np.where(t > 0, np.inf, -np.inf))
        by_length = np.where(length > 0, t / length, -np.inf)
        own_at = pivots[home]
        between = np.sqrt(np.maximum(0, (own_at**2).sum(axis=1)[:, None] - 2 * (own_at @ pivots.T) + at**2))
        own_apart = np.take_along_axis(apart, home[:, None].astype(np.int64), axis=1)
        plane = (apart**2 - own_apart**2 - 1e-9 * scale**2) / (2 * between)
    plane = np.where((np.arange(len(pivots))[None, :] == home[:, None]) | ~np.isfinite(plane), -np.inf, plane)
    low, high = np.maximum(by_score, apart - room) - 1e-6 * scale, apart + room
    needed = (known.count > 0) & (spare >= 0) & (low <= known.far) & (plane <= room) & (by_length <= known.norm + 1e-6 * scale)
    return needed, low, high, by_length - 1e-6 * scale


def needs(asked: DataFrame, pivots: np.ndarray, known: Summary, k: int) -> DataFrame:
    """(block, cell, low, high, length): the groups that a block of queries needs, with what its queries need of them at most."""
    width, groups = pivots.shape[1], len(pivots)

    def rows(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block, (low, high, length) in found.items():
            cell = np.flatnonzero(low < np.inf)
            yield pa.record_batch(
                [pa.array(np.full(len(cell), block, np.int64)), pa.array(cell, pa.int32()), pa.array(low[cell]), pa.array(high[cell]), pa.array(length[cell])],
                names=["block", "cell", "low", "high", "length"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch.num_rows, groups * k):
                pick = batch.slice(part.start, part.stop - part.start)
                q = np.frombuffer(b"".join(pick.column("v").to_pylist())).reshape(-1, width)
                needed, low, high, length = bounds(q, pick.column("query_id").to_numpy(), pick.column("cell").to_numpy(), pivots, known, k)
                low, high, length = np.where(needed, low, np.inf), np.where(needed, high, -np.inf), np.where(needed, length, np.inf)
                block = pick.column("block").to_numpy()
                for b in np.unique(block).tolist():
                    own = block == b
                    if b not in found:
                        if len(found) >= 64:
                            yield from rows(found)
                            found = {}
                        found[b] = np.stack((np.full(groups, np.inf), np.full(groups, -np.inf), np.full(groups, np.inf)))
                    now = found[b]
                    now[0] = np.minimum(now[0], low[own].min(axis=0))
                    now[1] = np.maximum(now[1], high[own].max(axis=0))
                    now[2] = np.minimum(now[2], length[own].min(axis=0))
        yield from rows(found)

    parts = asked.mapInArrow(run, "block long, cell int, low double, high double, length double")
    return parts.groupBy("block", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("length").alias("length"))


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k highest exact scores, ties to smaller ids; ids equal to own don't count.

    Products of lengths up to 2**53 are exact in doubles. Beyond, doubles with their error bound leave
    few rows, whose products are taken in whole numbers and held to a long's range.
    """
    norms = np.linalg.norm(x, axis=1)
    longest = norms.max(initial=0.0)
    for part in steps(len(q), len(x)):
        scores = q[part] @ x.T
        for i, s in zip(range(part.start, part.stop), scores, strict=True):
            length = np.linalg.norm(q[i])
            mine = ids != own[i]
            if length * longest <= 2.0**53:
                s = np.where(mine, s, -np.inf)
                least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                kept = np.flatnonzero(mine & (s >= least))
                exact = s[kept].astype(np.int64)
            else:
                error = length * norms * (x.shape[1] + 2) * 2.0**-52
                sure = np.where(mine, np.clip(s - error, -LONG, LONG), -np.inf)
                least = np.partition(sure, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
                kept = np.flatnonzero(mine & (np.clip(s + error, -LONG, LONG) >= least))
                whole = [int(a) for a in q[i].tolist()]
                found = [sum(a * int(b) for a, b in zip(whole, x[j].tolist(), strict=True)) for j in kept.tolist()]
                exact = np.array([min(max(v, -(2**63)), 2**63 - 1) for v in found], np.int64)
            order = np.lexsort((ids[kept], ~exact))[:k]
            yield i, ids[kept[order]], exact[order]


@dataclass
class Sent:
    """What goes where: queries and rows dealt to (block, chunk), with the numbers of rows and of query blocks."""

    queries: DataFrame
    rows: DataFrame
    width: int
    data_rows: int
    query_blocks: int
    chunks: int


def send(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str) -> Sent | None:
    """Deal queries by their pivots to blocks, and to each block the rows that its bounds leave; None without rows or queries."""
    spark = vectors.sparkSession
    data = at_most(cut(integers(vectors, id_col, vector_col)), k)
    asked = cut(integers(queries, id_col, vector_col).distinct()).withColumn("query", F.monotonically_increasing_id())
    n, width = data.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    many = max(1, min(PIVOTS[1], PIVOT_NUMBERS // width, max(PIVOTS[0], round(2 * n**0.5))))
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).select("v").toArrow().column("v").combine_chunks()
    if not len(drawn):
        return None
    pivots = np.unique(matrix(drawn, width), axis=0)
    # neighbours in this order are alike, so blocks of several groups are
    pivots = pivots[np.argsort(pivots @ np.linalg.svd(pivots / max(1.0, np.abs(pivots).max()), full_matrices=False)[2][0], kind="stable")]
    grouped = cut(placed(data, pivots, "vec_id long"))
    known = summary(grouped, len(pivots), k)
    asked = cut(placed(asked.select(F.col("vec_id").alias("query_id"), "query", "v"), pivots, "query_id long, query long"))
    homes = np.zeros(len(pivots), np.int64)
    for r in asked.groupBy("cell").count().toLocalIterator():
        homes[r["cell"]] = r["count"]
    if not homes.sum():
        return None
    first, parts, chunks = dealt(known.count, min(DATA_BLOCK, max(1, -(-n // LEAST_BLOCKS))))
    begin, pieces, blocks = dealt(homes, QUERY_BLOCK)
    groups = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "first": first, "parts": parts, "begin": begin, "pieces": pieces}))
    groups = F.broadcast(groups)  # a row for each pivot
    asked = asked.join(groups, "cell").withColumn("block", F.col("begin") + F.pmod(F.xxhash64("query"), "pieces")).select("query_id", "query", "cell", "block", "v")
    needed = cut(needs(asked, pivots, known, k))
    wide = needed.join(groups, "cell").select("block", "cell", "low", "high", "length", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("chunk"))
    if needed.count() + int(parts.sum()) * blocks <= BROADCAST_NEEDS:
        wide = F.broadcast(wide)
    # a large group has a chunk for each part of it, so no key of this join has more than a block's rows
    held = grouped.join(groups, "cell").withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "parts")).select("vec_id", "cell", "far", "norm", "v", "chunk")
    rows = held.join(wide, ["cell", "chunk"]).where("far >= low and far <= high and norm >= length").select("block", "chunk", "vec_id", "v")
    where = wide.select("block", "chunk").distinct()
    return Sent(asked.select("query_id", "query", "block", "v").join(where, "block"), rows, width, n, blocks, chunks)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score of the k highest integer inner products.

    Rows and queries are grouped by their nearest pivot (rows drawn by a hash of the id, about twice
    the root of their number). Summaries of the groups bound each query's k-th best score from below
    and each group's scores from above; what a block of queries needs of a group is the union of what
    its queries need, and only the rows within those bounds are copied to that block. Large groups
    are split and small neighbours share a block, so a task meets at most DATA_BLOCK rows and about
    QUERY_BLOCK queries; the best k of all blocks are ranked.

    A row with a query's own id is no candidate for it. Vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null id; shorter vectors count as padded
    with zeros. Repeated rows are candidates as often as they come; repeated queries count once, and
    different vectors of one query id are queries of their own. Scores beyond a long's range are held
    to its ends. Empty tables give an empty result. Other columns are not read.
    """
    sent = send(vectors, queries, k, id_col, vector_col)
    if sent is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = sent.width

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, own, query = right["vec_id"].to_numpy(), left["query_id"].to_numpy(), left["query"].to_numpy()
            for i, found, s in best(unpacked(left["v"], width), own, unpacked(right["v"], width), ids, k):
                out.append((np.full(len(found), own[i]), np.full(len(found), query[i]), found, s))
        columns = zip(*out, strict=True) if out else [[np.empty(0, np.int64)]] * 4
        found = {name: np.concatenate(c) for name, c in zip(("query_id", "query", "vec_id", "score"), columns, strict=True)}
        return pd.DataFrame(found | {"chunk": int(right["chunk"].iloc[0]) if len(right) else 0})

    near = sent.queries.groupBy("block", "chunk").cogroup(sent.rows.groupBy("block", "chunk")).applyInPandas(local, "query_id long, query long, vec_id long, score long, chunk long")
    order = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("less"), "vec_id"))), 1, k)
    if sent.chunks > 64:  # a query's answers come together in two steps
        near = near.groupBy("query_id", "query", (F.col("chunk") % 64).alias("chunk")).agg(order.alias("found")).select("query_id", "query", F.inline("found")).withColumn("score", F.bitwise_not("less"))
    return (
        near.groupBy("query_id", "query").agg(order.alias("found"))
        .select("query_id", F.posexplode("found").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.less").alias("score"))
    )


def visited_share(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Rows that top_k copies to query blocks, as a share of all rows times blocks; 0 without rows or queries."""
    sent = send(vectors, queries, k, id_col, vector_col)
    return sent.rows.count() / (sent.data_rows * sent.query_blocks) if sent else 0.0


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
