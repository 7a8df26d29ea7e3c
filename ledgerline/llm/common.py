"""What several operators share: scratch tables, reading, word patterns."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; only where that is unset and the session runs on
    this machine alone, as in tests, a folder under /tmp is set. On a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/checkpoints/ledgerline"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_live: list[Scratch] = []


@contextmanager
def passing() -> Iterator[None]:
    """What operators write within goes at the end: for results that are written or gathered by then."""
    here = len(_live)
    try:
        yield
    finally:
        for scratch in _live[here:]:
            scratch._end()
        del _live[here:]


@atexit.register
def _end_all() -> None:
    for scratch in _live:
        scratch._end()


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    They stay until ``drop``, the end of ``passing`` or that of the driver's process, as lazily
    evaluated results read them.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _live.append(self)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have ended before the process does
            pass

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_each(docs: DataFrame, scratch: Scratch, name: str = "ids") -> tuple[DataFrame, int]:
    """docs (doc_id, text) with one row of each doc_id, that of the text of the smallest hash; and the bytes of all texts.

    Texts move only for ids that repeat: these are found by a grouped minimum of hashes.
    """
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select("doc_id", row.alias("row"), F.octet_length("text").alias("bytes")).groupBy("doc_id").agg(F.count("*").alias("c"), F.min("row").alias("row"), F.sum("bytes").alias("bytes"))
    ids = scratch.write(ids, name)
    repeated, total = ids.agg(F.count(F.when(F.col("c") > 1, 1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if repeated:
        several = ids.where("c > 1").select("doc_id", "row")
        chosen = docs.withColumn("row", row).join(several, ["doc_id", "row"]).select("doc_id", "text").dropDuplicates(["doc_id"])
        docs = scratch.write(docs.join(several.select("doc_id"), "doc_id", "left_anti").unionByName(chosen), f"{name}-docs")
    return docs, int(total)


#: A key is hot that over 1 / HOT of all rows have; so fewer than HOT keys are.
HOT = 4096


def meet(rows: DataFrame, of: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with of, which has one row for each value of keys and c, the number of its rows among the total.

    Hot values, fewer than HOT of them in any table, are broadcast, so their rows stay where they are.
    """
    hot = F.broadcast(of.where(F.col("c") * HOT > total).drop("c"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(of.drop("c"), keys))


def numbered(df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) with a number for each document of a doc_id, in their order, and (doc, doc_id, row, only) where numbers aren't the doc_ids.

    Numbers are the doc_ids unless some repeat, which a grouped count of hashes finds. Then rows of
    one doc_id and text are one document, and those of one doc_id are in the order of their texts'
    hashes, row; only says that it is its doc_id's only text.
    """
    docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = scratch.write(docs.select("doc", row.alias("row")).groupBy("doc", "row").count(), "rows")
    if rows.groupBy("doc").agg(F.sum("count").alias("n")).where("n > 1").isEmpty():
        return docs, None
    several = F.count("*").over(Window.partitionBy("doc")) > 1
    # numbers of a sorted table rise with its order
    names = scratch.write(rows.withColumn("only", ~several).orderBy("doc", "row").select(F.monotonically_increasing_id().alias("number"), F.col("doc").alias("doc_id"), "row", "only"), "names")
    one = docs.withColumn("row", row).join(names.select("number", F.col("doc_id").alias("doc"), "row"), ["doc", "row"]).select("number", "text").dropDuplicates(["number"])
    return scratch.write(one.withColumnRenamed("number", "doc"), "documents"), names.withColumnRenamed("number", "doc")


def words(text: Column) -> Column:
    """The words of a text as an array; none of a null one. JVM only, and by plain searches, as patterns cost more."""
    flat = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs_of_keys(batches, keys: list[str]):
    """(batch, bounds) with whole runs of equal keys from batches that are sorted by keys.

    A run may cross batches; what is held back is the last run only.
    """
    import numpy as np
    import pyarrow as pa

    held: list = []

    def cut(table: pa.Table):
        n = table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), n)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        first = [batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys]
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys]
        before = [held[0].column(held[0].schema.get_field_index(k))[held[0].num_rows - 1].as_py() for k in keys]
        if first == last == before:
            continue  # the run goes on
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        held = table.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)
