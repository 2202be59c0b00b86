"""Exact top-k search (9): columnar branch-and-bound on inner products.

Vectors are packed into blocks held dimension by dimension. Queries (the rows whose id is divisible by ``every``) and
candidates (all rows) are dealt into groups; every query group meets every candidate group once. A query group has a fixed
size and candidates stream past it, so a task's memory is fixed, and there are at most TASKS tasks however many rows there
are. Inside, scores are accumulated a block of dimensions at a time; what is left of a score is at most the product of the
remaining norms, and candidates that no query of the lot can still rank are compacted away. Every query starts with a bound
that all tasks share: its k-th best score among one block of candidates. Scores are whole numbers held in doubles, exact below 2**53. Each task
returns the best k of each of its queries, and a window over those few rows ranks them.

Vectors that are null, or hold a null or non-finite component, take no part; so do rows with a null id. Shorter vectors
count as padded with zeros. Ties go to the smaller id. Rows that repeat the query's id count as its own. Tables with fewer
rows than k give all; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logfold.llm.common import prepare, stored, table

SCALE = 64.0
K = 20
EVERY = 20
#: Vectors in a packed block, queries compared at once, dimensions added at a time, and blocks in a group.
BLOCK = 2048
LOT = 64
DIMENSIONS = 16
GROUP = 4
#: Most tasks that queries and candidates are dealt over.
TASKS = 8192


def grid(queries: int, candidates: int) -> tuple[int, int]:
    """Groups of query and of candidate blocks: fixed for queries, as many for candidates as the tasks allow."""
    rows = max(1, -(-queries // GROUP))
    return rows, max(1, min(-(-candidates // GROUP), TASKS // rows))


def _pack(vectors: DataFrame, every: int, size: int) -> DataFrame:
    """side (0 queries, 1 candidates), ids, data (doubles, a row for each dimension) and dims of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {0: [], 1: []}

        def block(side: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            dims = max(len(v) for _, v in rows)
            data = np.zeros((dims, len(rows)))
            for j, (_, v) in enumerate(rows):
                data[: len(v), j] = v
            return pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "ids": [np.array([i for i, _ in rows], "<i8").tobytes()], "data": [data.tobytes()], "dims": pa.array([dims], pa.int32())})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                v = np.floor(SCALE * np.array(v, float))
                if not np.isfinite(v).all():
                    continue
                for side in (0, 1) if i % every == 0 else (1,):
                    held[side].append((i, v))
                    if len(held[side]) == size:
                        yield block(side, held[side])
                        held[side] = []
        for side, rows in held.items():
            if rows:
                yield block(side, rows)

    return vectors.mapInArrow(run, "side int, ids binary, data binary, dims int")


class _Best:
    """The best k candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.data, self.k = ids, data, k
        self.least = np.full(len(ids), -np.inf) if least is None else least  # the k-th best is this or more
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, data: np.ndarray, tail: np.ndarray) -> None:
        """Takes a block of candidates; tail has the norms of what follows each block of dimensions."""
        mine = _tails(self.data)
        for a in range(0, len(self.ids), LOT):
            lot = slice(a, min(a + LOT, len(self.ids)))
            least = np.maximum(self.score[lot, -1], self.least[lot])
            part = np.zeros((lot.stop - a, len(ids)))
            here, alive = data, np.arange(len(ids))
            for step, d in enumerate(range(0, len(data), DIMENSIONS)):
                part += self.data[d : d + DIMENSIONS, lot].T @ here[d : d + DIMENSIONS]
                most = part + np.outer(mine[step, lot], tail[step, alive]) * (1 + 1e-9) + 1e-6
                can = (most >= least[:, None]).any(axis=0)
                if can.sum() < 0.8 * len(alive):
                    alive, part, here = alive[can], part[:, can], here[:, can]
                if not len(alive):
                    break
            self._take(a, part, ids[alive])

    def _take(self, a: int, part: np.ndarray, ids: np.ndarray) -> None:
        for r in range(len(part)):
            q = a + r
            row = part[r]
            good = (row > self.score[q, -1]) | ((row == self.score[q, -1]) & (ids < self.vec[q, -1]))
            good &= (ids != self.ids[q]) & (row >= self.least[q])
            at = np.flatnonzero(good)
            if len(at) > 4 * self.k:
                at = at[row[at] >= np.partition(row[at], -self.k)[-self.k]]
            if len(at):
                s, v = np.concatenate((self.score[q], row[at])), np.concatenate((self.vec[q], ids[at]))
                order = np.lexsort((v, -s))[: self.k]
                self.score[q], self.vec[q] = s[order], v[order]

    def rows(self) -> pa.RecordBatch | None:
        q, j = np.nonzero(np.isfinite(self.score))
        if not len(q):
            return None
        return pa.RecordBatch.from_pydict({"query_id": self.ids[q], "vec_id": self.vec[q, j], "score": self.score[q, j].astype(np.int64)})


def _tails(data: np.ndarray) -> np.ndarray:
    """Norms of the dimensions after each block of them, a row for each block."""
    squares = data**2
    return np.sqrt(np.stack([squares[d + DIMENSIONS :].sum(axis=0) for d in range(0, max(len(data), 1), DIMENSIONS)]))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest scores of each query."""
    prepare(vectors.sparkSession)
    blocks = stored(_pack(vectors.select(F.col(id_col).cast("long"), F.col(vector_col)), every, block), "vector-blocks")
    count = {r.side: r["count"] for r in blocks.groupBy("side").count().collect()}
    groups = grid(count.get(0, 0), count.get(1, 0))
    sample = blocks.where("side = 1").limit(1).collect()  # one block, for the bounds
    at = F.monotonically_increasing_id()
    spread = F.shiftright(at, 33) + F.lit(7) * at.bitwiseAND(F.lit(2**33 - 1))
    numbered = blocks.withColumn("own", spread)
    q = numbered.where("side = 0").withColumn("q", F.pmod("own", F.lit(groups[0])))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each query's k-th best score among the sample."""
        for batch in batches:
            out = []
            for ids, raw, dims in zip(*(batch.column(c).to_pylist() for c in ("ids", "data", "dims"))):
                mine, other = _block(ids, raw, dims), _block(*(sample[0][c] for c in ("ids", "data", "dims")))
                data, theirs = _padded(mine[1], other[1])
                best = _Best(mine[0], data, k)
                best.meet(other[0], theirs, _tails(theirs))
                out.append(best.score[:, -1].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "least"])

    names = ["q", "side", "ids", "data", "dims"]
    q = q.select(*names).mapInArrow(bound, "q long, side int, ids binary, data binary, dims int, least binary").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups[1] - 1))))
    c = numbered.where("side = 1").withColumn("c", F.pmod("own", F.lit(groups[1]))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups[0] - 1)))).withColumn("least", F.lit(None).cast("binary"))
    names = [F.col("q").cast("long").alias("q"), F.col("c").cast("long").alias("c"), "side", "ids", "data", "dims", "least"]
    met = q.select(*names).unionByName(c.select(*names)).repartition(min(TASKS, groups[0] * groups[1]), "q", "c").sortWithinPartitions("q", "c", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                if (row["q"], row["c"]) != key:
                    yield from filter(None, (b.rows() for b in best))
                    key, best = (row["q"], row["c"]), []
                ids, data = _block(row["ids"], row["data"], row["dims"])
                if not row["side"]:
                    best.append(_Best(ids, data, k, np.frombuffer(row["least"])))
                    continue
                for b in best:
                    b.data, data = _padded(b.data, data)
                    b.meet(ids, data, _tails(data))
        yield from filter(None, (b.rows() for b in best))

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(data).reshape(dims, len(own))


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(a), len(b))
    return tuple(x if len(x) == n else np.vstack((x, np.zeros((n - len(x), x.shape[1])))) for x in (a, b))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
