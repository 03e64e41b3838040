"""What the operators of this subpackage share: the shared folder, tables that cut lineage, Arrow helpers, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from proofline.packages import ship
from proofline.scratch import shared_dir

#: Rows of keys, of some 24 bytes each, that are sent to all tasks at most; of more, both sides are dealt out by key.
SENT_KEYS = 400_000
#: Rows in one Arrow batch; with texts of 100,000 characters a batch then stays within tens of MB.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, since whole texts go to the Python workers, and send them this package, by Spark's own file server."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    ship(spark)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors.

    Tables that the returned plan still reads stay; drop() deletes those that it doesn't.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/proofline-{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """small: a table of few and short rows, which as many files as there are cores can hold, however many tasks make it."""
        path = self.path(name)
        (df.repartition(max(1, self.spark.sparkContext.defaultParallelism)) if small else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._scratch_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after them as no column of df, in upper or lower case, has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sent(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked to be sent to all tasks if it has few rows."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def without(docs: DataFrame, keys: list[Column], flagged: DataFrame) -> DataFrame:
    """docs with all its columns, without the rows whose key is flagged (a, b, gone); of those flagged but not gone, one for each key.

    keys: two numbers of a row. flagged: a written table, each key once. Texts move between tasks only if very many keys are flagged.
    """
    names = fresh(docs, "a", "b", "gone")
    marks = sent(flagged.select(*[F.col(c).alias(n) for c, n in zip(("a", "b", "gone"), names, strict=True)]))
    marked = docs.select("*", *[k.alias(n) for k, n in zip(keys, names[:2], strict=True)]).join(marks, names[:2], "left")
    out = marked.where(F.col(names[2]).isNull())
    if flagged.where("not gone").limit(1).count():
        out = out.unionByName(marked.where(~F.col(names[2])).dropDuplicates(names[:2]))
    return out.select(*docs.columns)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def order_key(key: Column) -> Column:
    """The key with null last."""
    return F.coalesce(key.cast("long"), F.lit(2**63 - 1))


def text_hash(text: Column) -> Column:
    """64 bits that tell texts apart within one doc_id; null and empty differ."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def _fields(schema: str) -> StructType:
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return kind


def _arrow(values: object, kind: pa.DataType) -> pa.Array:
    return (values if values.type == kind else values.cast(kind)) if isinstance(values, pa.Array) else pa.array(values, kind)


def map_batches(df: DataFrame, columns: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow of a function from a batch to the columns of schema."""
    kind = _fields(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = columns(batch)
                yield pa.RecordBatch.from_arrays([_arrow(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def add_columns(df: DataFrame, columns: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """df with the columns of schema, made from each batch of its rows; the names must be new."""
    kind = _fields(schema)
    arrow = to_arrow_schema(kind)
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = columns(batch)
                arrays = [*batch.columns[:width], *(_arrow(out[f.name], f.type) for f in arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([*batch.schema, *arrow]))

    return df.mapInArrow(run, StructType([*df.schema, *kind]))


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long: root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step pre-aggregates the smallest neighbour
    and writes its edges to the shared folder; nothing is collected but a count and a sum.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if large:
            out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", small=True)
    seen = state(now)
    while seen[0]:
        new = scratch.keep(star(star(now, True), False), "edges", small=True)
        scratch.drop(now)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
