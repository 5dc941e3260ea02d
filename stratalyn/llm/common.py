"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a whole text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model here may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def beside(df: DataFrame, name: str) -> str:
    """A column name made from ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, value: Column, run, name: str, kind: DataType) -> DataFrame:
    """``df`` with a column ``name``, made from ``value`` by ``run``, which maps an Arrow column to one of type ``kind``.

    Rows travel as one column, so no name of theirs can clash; one that is called ``name`` is replaced.
    """
    given = df.drop(name)
    packed = given.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in given.columns]).alias("row"), value.alias("value"))
    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField(name, kind)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), run(batch.column(1))], ["row", name])

    return packed.mapInArrow(each, schema).select("row.*", name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="stratalyn-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; lost executors do not lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared place, wherever that lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with at least this part of all rows is heavy; there are at most so many.
HEAVY = 1024


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and says in ``n`` how many rows of ``left`` have it.

    ``total`` is the number of rows of ``left``. Rows of ``right`` whose keys hold 1 / HEAVY of it, at most HEAVY of
    them, are looked up first and broadcast, so that no task gets all rows of a hot key; all others are joined by a
    shuffle. ``right`` should be cheap to compute twice.
    """
    found = right.where(F.col(n) * HEAVY >= total).collect()
    if not found:
        return left.join(right, keys, how).drop(n)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, right.schema))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(n) * HEAVY < total), keys, how)
    return left.join(hot, keys).unionByName(cold).drop(n)


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (bounded, one row a doc_id) with the text of that doc_id that has the smallest hash.

    However often a doc_id is repeated, one row of it goes on; minima are taken before the shuffle.
    """
    text = F.col("text").cast("string")
    best = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("best")).join(F.broadcast(ids), "doc_id")
    others = [c for c in ids.columns if c != "doc_id"]
    return best.groupBy("doc_id", *others).agg(F.min("best").alias("best")).select("doc_id", *others, F.col("best.text").alias("text"))
