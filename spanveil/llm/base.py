"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of keys that may be broadcast; some 100 bytes each at most.
FEW = 300_000
#: A key with more rows than this is not left to one task, unless over FEW keys are as frequent.
OFTEN = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(named(text).cast("string"), F.lit(""))


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, or, where one is taken (in any case), all of them with as many _ before them as it needs."""
    known, mark = {x.lower() for x in taken}, ""
    while any((mark + x).lower() in known for x in wanted):
        mark += "_"
    return [mark + x for x in wanted]


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder.

    It is the session's spark.checkpoint.dir. A folder of this machine is taken only by a
    session on one machine that names none, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spanveil-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet below the shared checkpoint folder; smaller than what `cut` writes."""
    at = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def salts(rows: int, per_salt: int = 200_000) -> int:
    """Into how many parts a group of so many rows is dealt."""
    return max(1, -(-rows // per_salt))


def joined(rows: DataFrame, told: DataFrame, key: str, often: int = OFTEN, few: int = FEW) -> DataFrame:
    """rows joined (inner) to told by `key`, which told has once each, with `n`: how many of rows have it.

    A told of at most `few` rows is broadcast. Of a larger one, the keys with most rows
    are (all with over `often`, or over so many more that they are few), so that no key
    has its rows in one task; the others are shuffled. n is dropped; rows and told should
    be cheap to read again.
    """
    size = told.count()
    if size <= few:
        return rows.join(F.broadcast(told.drop("n")), key)
    while told.where(F.col("n") > often).count() > few:
        often *= 10
    hot = F.broadcast(told.where(F.col("n") > often).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(told.where(F.col("n") <= often).drop("n"), key))


def frequent(told: DataFrame, most: int) -> int:
    """The least power of two so that at most so many rows of told have such an `n` or more; one if all are few enough."""
    by = {r.power: r["count"] for r in told.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()}
    power = max(by, default=-1) + 1
    while power > 0 and by.get(power - 1, 0) <= most:
        most -= by.get(power - 1, 0)
        power -= 1
    return 2**power


def without(docs: DataFrame, gone: DataFrame, is_gone: Column, few: int = FEW) -> DataFrame:
    """docs but those for which `is_gone` holds with a row of gone; a gone of few rows is broadcast."""
    return docs.join(F.broadcast(gone) if gone.count() <= few else gone, is_gone, "left_anti")
