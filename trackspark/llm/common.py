"""What the text operators share: keys, tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import shared_dir

#: Stands for a null doc_id wherever documents are joined by their id.
NULL_ID = -(2**63)


def exact(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ...: those whose names differ in case alone can be told apart."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of these very names, whatever others there are."""
    return exact(docs).select(*(F.col(f"c{docs.columns.index(n)}").alias(n) for n in names))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Lets Spark drop a query's shuffle files as soon as it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folders of stored tables.
TABLES: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, last: Iterable[DataFrame] = (), **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    What the write has shuffled goes when it has ended, as only the table is read from then on; so do the stored tables in
    `last`, which nothing reads after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    TABLES[table] = [path]
    drop(*last)
    return table


def drop(*tables: DataFrame) -> None:
    """Delete the folders of stored() tables that nothing reads any more; other DataFrames stay as they are."""
    for table in tables:
        spark = table.sparkSession
        for path in TABLES.pop(table, []):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of stored() tables with the same columns; one for drop()."""
    found = reduce(DataFrame.unionByName, tables)
    TABLES[found] = [path for table in tables for path in TABLES[table]]
    return found


def rows_of(docs: DataFrame, *columns: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`doc_id`, `text` and `columns` of every row, with a doc_id that no other row has, in the order of the ids given; and
    back(df, column, ...), which gives the rows' own ids for these keys in columns of a result.

    Ids are the keys, null as NULL_ID, where none repeats; this is asked of the id column alone. Otherwise the rows are
    numbered by id (repeated ones in any order): by ranges of ids, so that no task numbers them all.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    docs = only(docs, "doc_id", "text", *columns).select(id_, F.col("text").cast("string").alias("text"), *columns)
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty():
        return docs, lambda df, *names: df.withColumns({n: original_id(n) for n in names})
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "documents", compression="zstd")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stored(docs.select("doc_id", "row").repartitionByRange(parts, "doc_id", "row").withColumn("part", F.spark_partition_id()), "document-ids")
    starts = ids.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "row")) - 1
    keys = stored(ids.withColumn("place", place).join(starts, "part").select("row", (F.col("start") + F.col("place")).alias("key"), original_id()), "document-keys", [ids])

    def back(df: DataFrame, *names: str) -> DataFrame:
        order = df.columns
        for n in names:
            df = df.withColumnRenamed(n, "key").join(keys.select("key", F.col("doc_id").alias(n)), "key", "left").drop("key")
        return df.select(*order)

    return docs.join(keys.select("row", "key"), "row").select(F.col("key").alias("doc_id"), "text", *columns), back


def original_id(column: str = "doc_id"):
    """Undo the stand-in for null ids."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def map_rows(df: DataFrame, make: Callable[[Iterator[dict]], Iterator[dict]], schema: str | T.StructType, most: int = 4 << 20) -> DataFrame:
    """Run `make` once per partition: a stream of batches of about `most` bytes as {column: values} in, dicts of columns out.

    Values are lists, but for structs, which stay Arrow arrays and are only handed on.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: to_arrow_type(f.dataType) for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: c if pa.types.is_struct(c.type) else c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in small(batches, most))
        for out in make(columns):
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([as_arrow(v, types[k]) for k, v in out.items()], names=list(out))

    return df.mapInArrow(run, schema)


def small(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in parts of about `most` bytes, whatever the length of their texts."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def with_rest(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns, by number, as one struct `rest`, so that their names can't clash with an
    operator's or with each other."""
    others = [f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    own = [F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text")]
    return exact(docs).select(*own, F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """`changed` (doc_id, text, rest) with the columns and types of `docs`; n_chars follows the text."""
    columns = []
    for i, field in enumerate(docs.schema):
        if field.name in ("doc_id", "text"):
            value = F.col(field.name)
        elif field.name == "n_chars":
            value = F.length("text")
        else:
            value = F.col("rest").getField(f"c{i}")
        columns.append(value.cast(field.dataType).alias(field.name))
    return changed.select(*columns)


def held_out():
    """True for every row that models must not learn from."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2).alias("held_out")


def term_table(digits: bool) -> bytes:
    """For bytes.translate: letters A to Z lower-cased, what isn't ASCII (and digits, if they count) kept, the rest blank."""
    kept = [*range(0x61, 0x7B), *range(0x80, 0x100), *(range(0x30, 0x3A) if digits else ())]
    table = bytearray(b" " * 256)
    for byte in kept:
        table[byte] = byte
    table[0x41:0x5B] = table[0x61:0x7B]
    return bytes(table)
