"""Shared helpers: reading tables, mapping texts in Arrow batches, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of this application, under the one the cluster names (spark.checkpoint.dir).

    A folder of our own is set only where the session has none, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, with its lineage cut.

    With about so many narrow rows it lies in no more files than they need, whatever the number of shuffle partitions.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(4 + rows // 20_000)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a new place in the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote, once nothing reads it any more."""
    jvm, folders = df.sparkSession.sparkContext._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Free what finished steps have left: Spark removes the shuffle files and broadcasts of plans once the driver's JVM has collected those plans."""
    spark.sparkContext._jvm.System.gc()


#: A key with more than this share of the rows, and this many rows, is hot: its rows are dealt to SALTS tasks.
HOT_SHARE, HOT_ROWS, SALTS = 0.001, 1_000, 64


def hot_above(total: int) -> float:
    """Rows of a key from which it is hot, among so many rows in all."""
    return max(HOT_ROWS, total * HOT_SHARE)


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, counts: DataFrame) -> DataFrame:
    """Inner join of `rows` with `keyed` (one row per key) on a column.

    counts: (key, n), how many of `rows` have each key. Rows of a hot key are dealt over many
    tasks, and the key's one row is copied to each. A key is hot above a fixed share of all
    rows, so the list of hot keys has a fixed bound, whatever the input. Where no key is hot,
    one small query over `counts` is all that is added to a plain join.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = hot_above(total or 0)
    if (most or 0) <= least:
        return rows.join(keyed, on)
    hot = counts.filter(F.col("n") > least).select(on)
    listed = F.broadcast(rows.sparkSession.createDataFrame(hot.collect(), hot.schema).withColumn("hot__", F.lit(True)))
    is_hot = F.col("hot__").isNotNull()
    dealt = rows.join(listed, on, "left").withColumn("salt__", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot__")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = keyed.join(listed, on, "left").withColumn("salt__", F.explode(copies)).drop("hot__")
    return dealt.join(copied, [on, "salt__"]).drop("salt__")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def map_texts(
    docs: DataFrame,
    work: Callable[[Sequence[bytes]], dict[str, Sequence]],
    fields: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    pass_null: bool = False,
) -> DataFrame:
    """Rows (id, *fields): `work` gets the UTF-8 bytes of a batch of whole texts, Arrow batch by batch.

    Only the id and text columns are read, so other columns may have any name. A null text
    becomes b"" (or None with pass_null). A batch is cut so that about 8 MB of text, or one
    text, is worked on at a time.
    """
    source = docs.select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").cast("binary").alias("text__"))
    schema = StructType([docs.select(id_col).schema[0], *StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _slices(batch):
                cells = texts.to_pylist()
                out = work(cells if pass_null else [x or b"" for x in cells])
                yield pa.RecordBatch.from_arrays([ids.cast(arrow[0].type), *(pa.array(out[n], arrow.field(n).type) for n in names[1:])], schema=arrow)

    return source.mapInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The first column of Arrow batches, cut as `map_texts` does."""
    for batch in batches:
        for texts, _ in _slices(pa.RecordBatch.from_arrays([batch.column(0)] * 2, ["id", "text"])):
            yield texts


def _slices(batch: pa.RecordBatch, limit: int = 8_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    ids, texts = batch.column(0), batch.column(1)
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > limit:
            yield ids.slice(start, i - start), texts.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(batch) > start:
        yield ids.slice(start), texts.slice(start)
