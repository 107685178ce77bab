"""The index: a Parquet table of versioned vectors per namespace, newest version wins.

Writes only ever add a commit folder, and a commit is rewritten as a whole when it is
repeated, so a retried or replayed write changes nothing. Nothing is read and
overwritten in one job. Ids are unique within a commit, so the oldest commit, which holds
the bulk, is only scanned: reads resolve the versions of the later commits by their keys and take these
out of it. Few keys are sent to where the vectors are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fits
from .dense import nearest

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("num_tokens", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per key.

    An aggregation, not a window: copies of a key are combined before the shuffle, so a key
    with very many copies does not pile up in one task. Equal versions are decided by the
    remaining columns, so the result does not depend on the order of the rows.
    """
    rest = [c for c in rows.columns if c not in keys and c != version]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_b"))
    return best.select(*keys, "_b.*").select(*rows.columns)


def small(keys: DataFrame) -> DataFrame:
    """Keys with a broadcast hint when they are measured to be few, so that what they are looked up in stays where it is."""
    return F.broadcast(keys) if fits(keys) else keys


def upsert_index(current: DataFrame, incoming: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Insert or replace by key; the last write wins.

    ``current`` has one row per key. Only its rows whose key comes again are compared by version; the
    others, with their vectors, are passed on as they are, and not moved for an update of few rows.
    """
    again = small(incoming.select(*keys).distinct())
    compared = current.join(again, keys, "left_semi").unionByName(incoming, allowMissingColumns=True)
    untouched = current.join(again, keys, "left_anti")
    return untouched.unionByName(newest(compared, keys, version), allowMissingColumns=True).select(*compared.columns)


class Index:
    """A named index below ``root``. Opening one that does not exist creates it with the first write."""

    KEYS = ["namespace", "chunk_id"]

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType = VECTOR_SCHEMA):
        self.spark, self.path = spark, f"{root}/{name}"
        self.schema = schema

    def upsert(self, rows: DataFrame, commit: int, unique: bool = False) -> None:
        """Write one commit. Repeating a commit number replaces that commit.

        Rows that have an id more than once are reduced to one, unless the caller knows
        that there are none.
        """
        columns = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema
        ]
        rows = rows.select(*columns)
        if not unique:
            rows = newest(rows.withColumn("_same", F.lit(0)), self.KEYS, "_same").drop("_same")
        # The rebalance hint lets adaptive execution split a large namespace and join small ones.
        (
            rows.hint("rebalance", "namespace")
            .write.mode("overwrite")
            .partitionBy("namespace")
            .parquet(f"{self.path}/commit={commit}")
        )

    def commits(self) -> list[int]:
        """Numbers of the finished commits."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if n.startswith("commit=") and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("commit=")) for n in done)

    def versions(self) -> DataFrame:
        """All finished commits; a filter on namespace or commit is a partition filter."""
        schema = T.StructType([*self.schema.fields, T.StructField("commit", T.LongType())])
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path)
        return rows.parquet(*[f"{self.path}/commit={n}" for n in commits])

    def read(self, namespace: str | None = None) -> DataFrame:
        """The newest version of every chunk, of one namespace or of all."""
        rows, commits = self.versions(), self.commits()
        if namespace is not None:
            rows = namespace_filter(rows, namespace)
        if len(commits) < 2:
            return rows.drop("commit")
        first, later = rows.filter(F.col("commit") == commits[0]), rows.filter(F.col("commit") > commits[0])
        # Which commit is the newest of a chunk is told by keys alone; vectors are read last.
        newest_of = small(later.groupBy(*self.KEYS).agg(F.max("commit").alias("commit")))
        untouched = first.join(newest_of.select(*self.KEYS), self.KEYS, "left_anti")
        return untouched.unionByName(later.join(newest_of, [*self.KEYS, "commit"]).select(*untouched.columns)).drop("commit")

    def compact(self, root: str, name: str) -> Index:
        """The newest versions as the only commit of a new index."""
        target = Index(self.spark, root, name, self.schema)
        target.upsert(self.read(), 0, unique=True)
        return target

    def search(self, queries: DataFrame, k: int, metric: str = "cosine", namespace: str | None = None) -> DataFrame:
        corpus = self.read(namespace).select(F.col("chunk_id").alias("doc_id"), "embedding")
        return nearest(corpus, queries, k, metric)


def namespace_filter(rows: DataFrame, namespace: str) -> DataFrame:
    return rows.filter(F.col("namespace") == namespace)


def union_sources(file_chunks: DataFrame, issue_chunks: DataFrame) -> DataFrame:
    return file_chunks.unionByName(issue_chunks, allowMissingColumns=True)
