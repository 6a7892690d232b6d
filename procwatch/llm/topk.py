"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments; of each segment the mean and the deviation are kept. For
segments of length L the squared distance of two vectors is at least the sum of
L * ((difference of means)**2 + (difference of deviations)**2), so a candidate whose lower
bound is too far for the query's k-th best score so far is dropped, level by level; a level
looks at what the coarser ones left. Exact integer scores are computed for the survivors. A
score is an inner product, (|q|**2 + |x|**2 - distance**2) / 2, so bounds on one bound the other.

Segments are cut from rotated vectors, whose axes are in order of their spread, so that few of
them hold much of a distance: a finer level has more leading axes as segments of their own and
cuts the rest into more segments. A rotation leaves distances as they are, so any rotation gives
right bounds; it is fitted to a sample of ROTATION_SAMPLE candidates.

Queries and candidates travel as packed blocks. Every block of queries meets every block
of candidates in some task; blocks of candidates are dealt over `spread` tasks per block of
queries, and a task keeps the best k of each query of one block. Nothing is broadcast.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from procwatch.session import materialize

SCALE = 64
LEVELS = ((0, 1), (1, 1), (2, 2), (3, 4))  # quarters of the axes that stand alone, segments of the rest
ROTATION_SAMPLE = 2048    # candidates, those with the smallest hashes
ROTATION_WIDTH = 1024     # longer vectors keep their axes
ROTATION_BYTES = 64 << 20  # of all lengths' rotations; further lengths keep their axes
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 4096, 2048, 1024
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one length: width, ids, floor(SCALE * x) as doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(width)
            matrix = np.concatenate(rows) if rows else np.zeros((0, width))
            return pa.RecordBatch.from_pydict({
                "width": pa.array([width], pa.int32()),
                "ids": pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                "matrix": pa.array([matrix.astype("<f8").tobytes()], pa.binary())})

        for batch in batches:
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            widths = np.array([len(v) for v in batch["v"]], np.int64)
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.cumsum(widths) - widths
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                rows = np.floor(SCALE * flat[begins[mine][:, None] + np.arange(width)]).reshape(len(mine), width)
                for start in range(0, len(mine), size):
                    held = waiting.setdefault(int(width), ([], []))
                    held[0].append(ids[mine[start:start + size]])
                    held[1].append(rows[start:start + size])
                    if sum(map(len, held[0])) >= size:
                        yield block(int(width))
        for width in list(waiting):
            yield block(width)

    return vectors.mapInArrow(pack, "width int, ids binary, matrix binary")


def rotations(sample: list) -> dict[int, np.ndarray]:
    """Per length of vectors the axes of largest spread first, as columns; common lengths first."""
    of: dict[int, list] = {}
    for vector in sample:
        of.setdefault(len(vector), []).append(vector)
    found, room = {}, ROTATION_BYTES
    for width, rows in sorted(of.items(), key=lambda x: (-len(x[1]), x[0])):
        matrix = np.array(rows, float).reshape(len(rows), width)
        most = np.abs(matrix).max(initial=0.0)
        room -= 8 * width * width
        if room < 0 or not 1 < width <= ROTATION_WIDTH or not 0 < most < EXACT:
            continue
        spread = (matrix - matrix.mean(0)) / most
        found[width] = np.linalg.eigh(spread.T @ spread)[1][:, ::-1].copy()
    return found


def level_features(rotated: np.ndarray, level: tuple[int, int]) -> np.ndarray:
    """Leading axes, then means and deviations times the root of the segment length of the rest."""
    width = rotated.shape[1]
    lead = width * level[0] // 4
    columns = [rotated[:, :lead]]
    for part in np.array_split(np.arange(lead, width), level[1]):
        if len(part):
            cut, root = rotated[:, part], np.sqrt(len(part))
            columns += [(cut.mean(1) * root)[:, None], (cut.std(1) * root)[:, None]]
    return np.concatenate(columns, 1)


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, rotation: np.ndarray | None = None) -> None:
        self.ids, self.matrix, self.k, self.rotation = ids, matrix, k, rotation
        self.features = [level_features(self._rotated(matrix), level) for level in LEVELS]
        self.norms = (matrix ** 2).sum(1)
        n = len(ids)
        self.q, self.c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.limit = np.full(n, -np.inf)  # score of the k-th best, once there are k
        self.largest = float(np.abs(matrix).max()) if matrix.size else 0.0
        self.met, self.scored = 0, 0      # pairs, and those whose exact score was computed

    def _rotated(self, matrix: np.ndarray) -> np.ndarray:
        return matrix if self.rotation is None else matrix @ self.rotation

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        rotated = self._rotated(matrix)
        at, step = 0, 4 * self.k
        while at < len(ids):  # few at first, so that the limits are known soon
            part = slice(at, at + step)
            self._add(ids[part], matrix[part], rotated[part])
            at, step = at + step, min(STEP, 2 * step)

    def _survivors(self, norms: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) of all pairs that no level shows to be too far."""
        room = norms[None, :] + self.norms[:, None]
        # farthest squared distance at which a candidate can still reach the limit
        farthest = np.where(np.isneginf(self.limit)[:, None], np.inf, room - 2 * self.limit[:, None])
        farthest += 1e-9 * (room + np.abs(np.where(np.isinf(farthest), 0, farthest))) + 1e-6
        reach = (room - farthest) / 2  # least bound on the score of a pair that stays
        q = c = None
        for mine, level in zip(self.features, LEVELS):
            theirs = level_features(rotated, level)
            # score <= (|q|**2 + |x|**2 - distance of features**2) / 2, taken apart
            slack_q, slack_c = (self.norms - (mine ** 2).sum(1)) / 2, (norms - (theirs ** 2).sum(1)) / 2
            if q is None or 8 * len(q) > room.size:
                fits = mine @ theirs.T + slack_q[:, None] + slack_c[None, :] >= reach
                if q is not None:
                    fits = fits[q, c]
                    q, c = q[fits], c[fits]
                else:
                    q, c = np.nonzero(fits)
            else:
                bound = np.einsum("ij,ij->i", mine[q], theirs[c]) + slack_q[q] + slack_c[c]
                fits = bound >= reach[q, c]
                q, c = q[fits], c[fits]
            if not len(q):
                break
        return q, c

    def _add(self, ids: np.ndarray, matrix: np.ndarray, rotated: np.ndarray) -> None:
        q, c = self._survivors((matrix ** 2).sum(1), rotated)
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        self.met += len(self.ids) * len(ids)
        self.scored += len(q)
        most = self.largest * (float(np.abs(matrix).max()) if matrix.size else 0.0) * max(1, matrix.shape[1])
        if most >= EXACT:  # beyond what doubles add exactly
            left, right = (m.astype(object) for m in (self.matrix, matrix))
            score = np.array([sum(int(a) * int(b) for a, b in zip(left[i], right[j])) for i, j in zip(q, c)], object)
            score = np.clip(score, -(1 << 63), (1 << 63) - 1) if len(score) else score
        elif 8 * len(q) > len(self.ids) * len(ids):
            score = (self.matrix @ matrix.T)[q, c]
        else:
            score = np.einsum("ij,ij->i", self.matrix[q], matrix[c])
        keep = score >= self.limit[q]
        self._merge(q[keep], ids[c[keep]], score[keep])

    def _merge(self, q: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        q, c = np.concatenate([self.q, q]), np.concatenate([self.c, c])
        score = np.concatenate([self.score, score])
        order = np.lexsort((-score, c, q))
        q, c, score = q[order], c[order], score[order]
        first = np.ones(len(q), bool)  # a repeated id counts once, with its best score
        first[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, score = q[first], c[first], score[first]
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.c, self.score, rank = q[keep], c[keep], score[keep], rank[keep]
        full = rank == self.k - 1
        self.limit[self.q[full]] = self.score[full].astype(np.float64)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(self.ids[self.q], pa.int64()), "vec_id": pa.array(self.c, pa.int64()),
            "score": pa.array([int(s) for s in self.score], pa.int64())})


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, ties to smaller ids.

    Components are floor(64 * x), x as double, and scores exact integers. A query does not
    meet candidates of its own id, nor of another length. Null vectors, and those that hold
    null or non-finite components, take no part on either side, nor do null ids. Rows that
    repeat an id and vector count once; of different vectors with one id the best counts.
    Queries without candidates have no rows. Only the two named columns are read.
    """
    def taken(df: DataFrame) -> DataFrame:
        return df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    # a block's number is made once and written, so that both sides of the join agree on it
    asked = taken(queries)
    tasks = asked.count() // QUERY_BLOCK + 1  # so that blocks are full
    blocks = materialize(_packed(asked.repartition(tasks), QUERY_BLOCK)
                         .withColumn("block", F.monotonically_increasing_id()), "topk-queries")
    packed = materialize(_packed(taken(candidates), CANDIDATE_BLOCK)
                         .withColumn("n", F.monotonically_increasing_id()), "topk-candidates")
    # tasks per block of queries: one for each 16 blocks of candidates, 4 at least; a task's limits
    # rise with what it has seen
    spread = max(4, packed.count() // 16)
    sample = taken(candidates).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(ROTATION_SAMPLE)
    turned = rotations([r["v"] for r in sample.select("v").collect()])
    numbers = blocks.groupBy("width").agg(F.collect_list("block").alias("blocks"))
    # 8 bytes for each 4096 queries of a length, and a row for each length
    left = (packed.join(F.broadcast(numbers), "width")
            .select(F.explode("blocks").alias("block"), F.pmod(F.xxhash64("n"), F.lit(spread)).alias("deal"),
                    F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"), "width"))
    right = (blocks.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
             .select("block", F.col("deal").cast("long").alias("deal"), F.col("ids").alias("q_ids"),
                     F.col("matrix").alias("q_matrix")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch["width"][i].as_py()

                def matrix(side: str) -> tuple[np.ndarray, np.ndarray]:
                    ids = np.frombuffer(batch[f"{side}_ids"][i].as_buffer(), "<i8")
                    return ids, np.frombuffer(batch[f"{side}_matrix"][i].as_buffer(), "<f8").reshape(len(ids), width)

                if batch["block"][i].as_py() != number:
                    if best is not None:
                        yield best.rows()
                    number, best = batch["block"][i].as_py(), Best(*matrix("q"), k, turned.get(width))
                best.add(*matrix("c"))
        if best is not None:
            yield best.rows()

    met = (left.join(right.hint("shuffle_merge"), ["block", "deal"])
           .select("block", "width", "q_ids", "q_matrix", "c_ids", "c_matrix")
           .sortWithinPartitions("block").mapInArrow(meet, "query_id long, vec_id long, score long"))
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
