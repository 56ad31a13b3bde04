"""Vector collection: upsert, payload filters, cosine search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioworks.operators.lexical import files_state
from folioworks.operators.ranking import top_per_group
from folioworks.session import shared_dir, write_once

#: Rows of a tile, the points that a task of the batch search holds at once.
TILE_POINTS = 8192
#: Most cells of a stored table, most rows its centres are fitted on, and rounds of the fit.
MOST_CELLS, SAMPLE_ROWS, FIT_ROUNDS = 256, 20_000, 8


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))  # null for a zero vector


def nearest(points: DataFrame, query: Column, k: int, vector: str = "embedding") -> DataFrame:
    """O3: the ``k`` points closest to one query vector."""
    return (points.withColumn("semantic_score", cosine(F.col(vector), query))
            .orderBy(F.desc("semantic_score"), "doc_id").limit(k))


def centroid(points: DataFrame, vector: str = "embedding") -> Column:
    """Mean vector of a selection as a literal; one row per dimension comes back."""
    means = (points.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim")
             .agg(F.avg(F.col("v").cast("double")).alias("v")).orderBy("dim"))
    return F.array(*[F.lit(row["v"]) for row in means.collect()])


def nearest_batch(points: DataFrame, queries: DataFrame, k: int, match: str | None = None) -> DataFrame:
    """O3 for many queries: exact search over tiles of points.

    ``points`` has (doc_id, embedding), ``queries`` has (query_id, embedding);
    with ``match`` both carry that column and only equal values are compared.
    A point is shuffled once, to its tile; a query goes to every tile, which
    hands on its ``k`` best points for it.  Neither side passes through the
    driver.  Vectors that are null, zero or not finite take no part.
    """
    tiles = -(-points.count() // TILE_POINTS) or 1
    equal = [F.col(match).alias("match")] if match else []

    def rows(df: DataFrame, name: str, slot: Column) -> DataFrame:
        # New names for all columns: both sides may come from the same table.
        held = df.where("embedding IS NOT NULL").select(F.col(name).alias("id"), F.col("embedding").alias("vector"), *equal)
        held = held.where("match IS NOT NULL") if match else held
        return held.withColumn("slot", slot).withColumn("tile", F.to_json(F.struct("slot", *(["match"] if match else []))))

    left = rows(points, "doc_id", F.pmod(F.xxhash64("id"), F.lit(tiles).cast("bigint")))
    right = rows(queries, "query_id", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))
    return top_per_group(_meet(left, right, k), ["query_id"], [F.desc("semantic_score"), F.col("doc_id")], k)


def _meet(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best points of every tile for each query sent to it; both sides are (tile, id, vector).

    A tile's points are sorted in front of its queries, so a task holds one tile
    and streams any number of queries past it.
    """
    side = lambda df, kind: df.select("tile", F.lit(kind).alias("kind"), "id", "vector")
    dealt = side(points, 0).unionByName(side(queries, 1)).repartition("tile").sortWithinPartitions("tile", "kind")
    return dealt.mapInPandas(_tile_search(k), "query_id long, doc_id long, semantic_score double")


def _unit_rows(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction."""
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    matrix = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return frame["id"].to_numpy()[good], matrix[good] / norms[good, None]


def _tile_search(k: int):
    def best(docs: np.ndarray, matrix: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> pd.DataFrame:
        scores, parts = asked @ matrix.T, []
        take = min(k, len(docs))
        least = np.partition(scores, len(docs) - take, axis=1)[:, len(docs) - take]
        for query, row, bound in zip(ids, scores, least):
            near = np.flatnonzero(row >= bound)  # ties at the bound are settled by the id
            near = near[np.lexsort((docs[near], -row[near]))[:take]]
            parts.append(pd.DataFrame({"query_id": query, "doc_id": docs[near], "semantic_score": row[near]}))
        return pd.concat(parts)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, parts, held = None, [], None
        for frame in frames:
            for (name, kind), rows in frame.groupby(["tile", "kind"], sort=False):
                if name != tile:
                    tile, parts, held = name, [], None
                if kind == 0:
                    parts.append(_unit_rows(rows))
                    continue
                if held is None:
                    full = [p for p in parts if len(p[0])]
                    held = (np.concatenate([d for d, _ in full]), np.concatenate([m for _, m in full])) if full else ()
                ids, asked = _unit_rows(rows)
                if held and len(ids):
                    yield best(*held, ids, asked)

    return search


# --- a stored table by coarse cell -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class VectorTable:
    """Points stored in one folder per coarse cell, searched exactly by the cells a query can need.

    ``centres`` are unit vectors, one per cell; ``rows`` counts a cell's points
    and ``reach`` is the angle from its centre to the farthest of them.  They are
    of bounded size (``MOST_CELLS``), the points are not.
    """

    spark: SparkSession
    path: str
    centres: np.ndarray
    rows: np.ndarray
    reach: np.ndarray

    def points(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The points, or those of some cells: a partition filter, so that no other folder is read."""
        stored = self.spark.read.parquet(f"{self.path}/points")
        return stored if cells is None else stored.where(F.col("cell").isin([int(c) for c in cells]))

    def search(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, doc_id, semantic_score, rn): the ``k`` nearest points that meet ``where``, a condition on the payload.

        A query first searches the cell whose centre is nearest.  Its k-th score
        there bounds the rest: a point at most ``reach`` away from its centre has
        no smaller angle to the query than the centre's less ``reach``, so a cell
        beyond that angle is not visited.  The result is that of a whole search.
        """
        if not len(self.rows):  # a table without any point
            return self.spark.createDataFrame([], "query_id long, doc_id long, semantic_score double, rn int")
        asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").alias("id"), F.col("embedding").alias("vector"))
        home = write_once(self._visits(asked, None), "home-cells")
        first = write_once(self._scan(home, k, where), "home-hits")
        kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("semantic_score")).alias("least"))
        bounded = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        others = write_once(self._visits(bounded, "least"), "other-cells")
        found = first.unionByName(self._scan(others, k, where))
        return top_per_group(found, ["query_id"], [F.desc("semantic_score"), F.col("doc_id")], k)

    def _visits(self, asked: DataFrame, least: str | None) -> DataFrame:
        """(id, vector, cell): the nearest cell of every query, or with ``least`` the others that may hold something better."""
        centres, reach, filled = self.centres, self.reach, self.rows > 0

        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                ids, unit = _unit_rows(frame)
                if not len(ids):
                    continue
                angle = np.where(filled, np.arccos(np.clip(unit @ centres.T, -1, 1)), np.inf)
                home = angle.argmin(axis=1)
                kept = np.zeros(angle.shape, bool)
                if least is None:
                    kept[np.arange(len(ids)), home] = True
                else:
                    bound = frame.set_index("id")[least].loc[ids].to_numpy()
                    nearest = np.cos(np.maximum(0, np.where(filled, angle, np.pi) - reach))
                    kept = filled & (nearest >= bound[:, None] - 1e-6)
                    kept[np.arange(len(ids)), home] = False
                query, cell = np.nonzero(kept)
                vectors = frame.set_index("id")["vector"].loc[ids].to_numpy()
                yield pd.DataFrame({"id": ids[query], "vector": vectors[query], "cell": cell.astype(np.int32)})

        return asked.mapInPandas(visit, f"id long, vector {asked.schema['vector'].dataType.simpleString()}, cell int")

    def _scan(self, visits: DataFrame, k: int, where: Column | None) -> DataFrame:
        """The best ``k`` of every query in the cells it visits, cut into tiles where a cell is large."""
        slices = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // TILE_POINTS))) for n in self.rows]), F.col("cell") + 1)
        tile = F.concat_ws("/", "cell", "slot")
        cells = [r.cell for r in visits.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
        points = self.points(cells)
        points = points if where is None else points.where(where)
        points = points.select("cell", F.col("doc_id").alias("id"), F.col("embedding").alias("vector")).withColumn("slot", F.pmod(F.xxhash64("id"), slices))
        sent = visits.withColumn("slot", F.explode(F.sequence(F.lit(0), slices - 1)))
        found = _meet(points.withColumn("tile", tile), sent.withColumn("tile", tile), k)
        return top_per_group(found, ["query_id"], [F.desc("semantic_score"), F.col("doc_id")], k).drop("rn")


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a bounded sample of unit vectors, by rounds of assignment and mean."""
    rng = np.random.default_rng(7)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(FIT_ROUNDS):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(of, sample[:, d], len(centres)) for d in range(sample.shape[1])], axis=1)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def store_vectors(points: DataFrame, path: str, cells: int | None = None) -> VectorTable:
    """Store ``points`` (doc_id, embedding and any payload) by coarse cell; vectors without a direction are left out.

    The centres are fitted on at most ``SAMPLE_ROWS`` rows, the first by a hash
    of their ids; every row is stored.
    """
    spark = points.sparkSession
    lot = F.xxhash64("doc_id")
    ids, sample = _unit_rows(points.where("embedding IS NOT NULL").orderBy(lot).limit(SAMPLE_ROWS).select(F.col("doc_id").alias("id"), F.col("embedding").alias("vector")).toPandas())
    wanted = cells or max(1, min(MOST_CELLS, int(points.count() ** 0.5)))
    centres = fit_centres(sample, wanted) if len(ids) else np.zeros((0, 0))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(_at=np.arange(len(frame)))
            at, unit = _unit_rows(frame.rename(columns={"embedding": "vector"})[["_at", "vector"]].rename(columns={"_at": "id"}))
            if len(at) and len(centres):
                scores = unit @ centres.T
                cell = scores.argmax(axis=1)
                angle = np.arccos(np.clip(scores[np.arange(len(at)), cell], -1, 1))
                yield frame.iloc[at].drop(columns="_at").assign(cell=cell.astype(np.int32), angle=angle)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    placed = points.where("embedding IS NOT NULL").mapInPandas(place, f"{fields}, cell int, angle double")
    placed.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/points")
    kept = spark.read.schema(placed.schema).parquet(f"{path}/points").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach"))
    facts = {r.cell: (r.n, r.reach) for r in kept.collect()}  # one row per cell
    rows = [(i, c.tolist(), *facts.get(i, (0, 0.0))) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, n long, reach double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return open_vectors(spark, path)


def open_vectors(spark: SparkSession, path: str) -> VectorTable:
    """A stored table; its centres are written last, so a table that has them is whole."""
    facts = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS rows
    column = lambda name, kind: np.array([r[name] for r in facts], kind)
    return VectorTable(spark, path, column("centre", np.float64), column("n", np.int64), column("reach", np.float64))


def stored_vectors(points: DataFrame, label: str) -> VectorTable:
    """The table of ``points`` in the shared folder, stored at the first call and again once its files change."""
    spark = points.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vectors-{files_state(points, label)}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centres/_SUCCESS")
    there = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    return open_vectors(spark, path) if there else store_vectors(points, path)


def latest_points(points: DataFrame, key: str, version: str) -> DataFrame:
    """One point per key, the newest version wins."""
    row = F.struct(*[F.col(c) for c in points.columns])
    return points.groupBy(key).agg(F.max_by(row, version).alias("_r")).select("_r.*")
