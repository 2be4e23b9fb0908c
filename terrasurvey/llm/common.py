"""Helpers that the corpus operators share: tables in the cluster's shared folder, word patterns and ids."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables: spark.checkpoint.dir of the session, or a new one where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later stages start from the files, also if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right by key (inner or left), keys with very many rows spread over tasks. right has a row for each key, with the number of left's rows (`count`).

    rows: how many rows left has. A key is spread if it has over a ten-thousandth of them (1000 at least), so that fewer than 10,000 keys are
    broadcast; its rows are dealt to parts by all their values, and its row on the right is repeated for each part.
    """
    most = max(1000, rows // 10_000)
    parts, part = fresh([*left.columns, *right.columns], "parts", "part")
    hot = right.where(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("int").alias(parts))
    n = F.coalesce(F.col(parts), F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop(parts)
    every = F.when(F.col(count) > most, F.ceil(F.col(count) / most).cast("int")).otherwise(1)
    repeated = right.withColumn(part, F.explode(F.sequence(F.lit(0), every - 1)))
    return dealt.join(repeated, [key, part], how).drop(part)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")
