"""An index over vectors: inverted lists under centres, read by partition, with exact scores of what is read.

Centres are fitted on a bounded sample; every vector is in one list, that of its nearest centre. A
search reads the lists of the centres nearest to each query. The largest angle between a centre
and a vector of its list bounds the cosine of any vector there, so a search that goes on to the lists whose
bound isn't below what it has found is exact and still leaves out the others.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from ..model import TOP_K, within
from ..session import ship, written
from .best import near
from .disclosure import nearest, with_norms
from .memory import query_blocks

#: Vectors that centres are fitted on, the most centres, and the lists that a search reads for a query by default: at least so many, and this share of all.
#: Vectors that hardly lie in clusters need the share for a recall of 0.9; of those that do, a few lists are enough.
SAMPLE, CELLS, PROBES, SHARE = 65_536, 4096, 24, 0.55
#: Vectors of a list that one task writes; a list may hold any share of all vectors.
LIST_ROWS = 1_000_000
#: Scores are rounded to six places before they are compared.
SLACK = 1e-6


class VectorIndex:
    """An index below a folder: ``model`` (the centres), ``cells`` (rows and largest angle of each list by part) and ``lists`` (Parquet by part and cell)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Fits centres on SAMPLE vectors of least hash of doc_id, about as many as the square root of all vectors, at most CELLS, and puts every vector (doc_id, embedding and any other columns) in a list.

        Vectors without a direction (zeros) are in a list of their own; null ones are in none. A doc_id is expected once.
        """
        rows = self._usable(vectors)
        n = rows.count()
        k = max(1, min(CELLS, cells or math.isqrt(n)))
        sample = rows.filter("norm > 0").withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(SAMPLE).select(array_to_vector("embedding").alias("features"))
        sample = written(sample)
        if sample.isEmpty():
            sample = self.spark.range(1).select(array_to_vector(F.array(F.lit(1.0))).alias("features"))
        model = KMeans(k=max(2, k), seed=seed, maxIter=15, distanceMeasure="cosine").fit(sample.repartition(max(1, min(64, sample.count() // 2048))))
        model.write().overwrite().save(f"{self.root}/model")
        self._put(rows, model)
        return self

    def add(self, vectors: DataFrame) -> VectorIndex:
        """More vectors under the centres as they are. A doc_id that the index has already is an error: build anew for what was replaced."""
        rows = self._usable(vectors)
        if not rows.select("doc_id").join(self._lists().select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("the index has some of these doc_ids")
        self._put(rows, self._model())
        return self

    def _model(self) -> KMeansModel:
        return KMeansModel.load(f"{self.root}/model")

    @staticmethod
    def _usable(vectors: DataFrame) -> DataFrame:
        return with_norms(vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).filter("embedding IS NOT NULL"))

    def _put(self, rows: DataFrame, model: KMeansModel) -> None:
        columns = rows.columns
        centres = [np.asarray(c) / max(np.linalg.norm(c), 1e-300) for c in model.clusterCenters()]  # at most CELLS
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        some = model.transform(rows.filter("norm > 0").withColumn("_v", array_to_vector("embedding")).withColumnRenamed("_v", "features")).select(*columns, F.col("prediction").alias("cell"))
        turned = some.join(F.broadcast(known), "cell").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), E.dot(F.col("embedding"), F.col("centre")) / F.col("norm"))))).drop("centre")
        zeros = rows.filter("norm = 0").select(*columns, F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
        placed = written(turned.select(*columns, "cell", "angle").unionByName(zeros))
        cells = written(placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")))
        part = uuid.uuid4().hex
        salted = placed.drop("angle").join(F.broadcast(cells.select("cell", F.ceil(F.col("rows") / LIST_ROWS).alias("_n"))), "cell").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), "_n"))
        salted.repartition("cell", "_salt").drop("_salt", "_n").write.partitionBy("cell").parquet(f"{self.root}/lists/part={part}")
        cells.coalesce(1).write.parquet(f"{self.root}/cells/part={part}")

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/lists").drop("part")

    def cells(self) -> DataFrame:
        """cell, rows and angle of every list."""
        return self.spark.read.parquet(f"{self.root}/cells").groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("angle").alias("angle"))

    def _places(self, queries: DataFrame, stretch: float) -> DataFrame:
        """query_id, cell, place (from 0, nearest first) and bound, the most score of any vector in the list, for every query and list."""
        model = self._model()
        found = {r["cell"]: r["angle"] for r in self.cells().collect()}  # at most CELLS + 1
        ids = np.array(sorted(i for i in found if i >= 0), np.int32)
        centres = np.array([np.asarray(model.clusterCenters()[i]) / max(np.linalg.norm(model.clusterCenters()[i]), 1e-300) for i in ids]).reshape(len(ids), len(model.clusterCenters()[0]))
        angles = np.array([found[i] for i in ids.tolist()])
        zeros = -1 in found
        ship(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q = np.array(b.column(1)[i].as_py() or [0.0], np.float64)
                    n = np.linalg.norm(q)
                    cos = np.clip(centres @ (q / n), -1, 1) if n > 0 and len(ids) and len(q) == centres.shape[1] else np.zeros(len(ids))
                    bound = np.clip(np.cos(np.maximum(np.arccos(cos) - angles, 0)) * stretch, 0, 1) if n > 0 else np.zeros(len(ids))
                    order = np.argsort(-cos, kind="stable")
                    cell, bound = np.append(ids[order], [-1] * zeros).astype(np.int32), np.append(bound[order], [0.0] * zeros)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(cell), b.schema.field(0).type), pa.array(cell), pa.array(np.arange(len(cell), dtype=np.int32)), pa.array(bound)], ["query_id", "cell", "place", "bound"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", F.col("embedding").cast("array<double>")).mapInArrow(run, f"query_id {kind}, cell int, place int, bound double")

    def search(self, queries: DataFrame, top_k: int = TOP_K[2], probes: int | None = None, exact: bool = False, directory: bool = False, stretch: float = 1.0) -> DataFrame:
        """query_id, doc_id, score and rank, as ``disclosure.nearest`` gives them, of the vectors in the ``probes`` lists nearest to each query (query_id, embedding and, with directory, directory: a prefix of the lists' hierarchy_path).

        A query that has fewer than top_k results goes on to all lists, and with exact every one does to those
        whose bound isn't below its last result; then the rows are those of ``nearest``.
        """
        within("top_k", top_k, TOP_K)
        probes, out = max(PROBES, math.ceil(SHARE * self.cells().count())) if probes is None else probes, None
        for block in query_blocks(queries.select("query_id", "embedding", *(["directory"] if directory else []))):
            block = written(block)
            places = written(self._places(block, stretch))
            hits = written(self._hits(block, places.filter(F.col("place") < probes), top_k, directory, stretch))
            last = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            open_ = (F.coalesce("n", F.lit(0)) < top_k) | (F.lit(exact) & (F.col("bound") + SLACK >= F.col("least")))
            more = written(places.filter(F.col("place") >= probes).join(F.broadcast(last), "query_id", "left").filter(open_).select("query_id", "cell"))
            if not more.isEmpty():
                best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
                both = hits.drop("rank").unionByName(self._hits(block, more, top_k, directory, stretch).drop("rank"))
                hits = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
            out = hits if out is None else out.unionByName(hits)
        return out

    def _hits(self, block: DataFrame, pairs: DataFrame, top_k: int, directory: bool, stretch: float) -> DataFrame:
        """The best of the lists that each query reads: only these lists' partitions are scanned, and only their rows meet the queries."""
        cells = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most CELLS + 1
        lists = self._lists().filter(F.col("cell").isin(cells))
        reads = pairs.groupBy("query_id").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 2)).alias("reads"))  # a bit for each list
        q = block.select("query_id", F.col("embedding").cast("array<double>").alias("q_e"), E.norm(F.col("embedding")).alias("q_n"), (F.col("directory") if directory else F.lit(None).cast("string")).alias("q_dir"))
        some = q.join(F.broadcast(reads), "query_id").collect()  # a block of queries
        which = np.array([np.unpackbits(np.frombuffer(bytes(r["reads"]), np.uint8), bitorder="little") for r in some], bool).reshape(len(some), -1)
        keys, rows = list(range(len(some))), lists.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), "norm", *(["hierarchy_path"] if directory else []), "cell")
        ship(self.spark)
        found = rows.mapInArrow(near(keys, [(r["q_e"], r["q_n"], r["q_dir"]) for r in some], top_k, stretch, {c: which[:, c + 1] for c in cells}), T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
        ids = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(some)], T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", block.schema["query_id"].dataType)]))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return found.join(F.broadcast(ids), "query").select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)

    def recall(self, queries: DataFrame, top_k: int = TOP_K[2], probes: int | None = None) -> float:
        """The share of ``nearest``'s results for these queries that a search finds; of ties any counts."""
        exact = nearest(self._lists(), queries, top_k)
        least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        got = self.search(queries, top_k, probes).join(least, "query_id").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("least")).alias("found"))
        return got.agg((F.sum("found") / F.sum("n")).alias("recall")).first()["recall"]
