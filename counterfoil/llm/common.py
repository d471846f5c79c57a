"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """``pick(df, out="name")``: the named columns only, under the given names.

    Columns are found by exact, case-sensitive name (the first one wins), so
    other columns may clash with them or with an operator's own names.
    """
    flat = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_in{df.columns.index(name)}").alias(out)
                         for out, name in wanted.items()])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files:
    later passes neither recompute it nor see another row order."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and
    read back: the planner then knows its size, and broadcasts it to a join
    only when that is under the session's threshold."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, out: str = "uid") -> DataFrame:
    """``cut`` plus an id per row.  The files fix the rows of each partition,
    so the id is the same in every later pass, also after lost executors."""
    return cut(df).withColumn(out, F.monotonically_increasing_id())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def salted_lookup(facts: DataFrame, dims: DataFrame, key: str, row: str, salts: int) -> DataFrame:
    """``facts`` left join ``dims`` (one row a key) with a hot key spread over
    ``salts`` tasks: each dims row is repeated once a salt, each facts row
    takes the salt of its ``row`` id."""
    d = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    f = facts.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    return f.join(d, [key, "_salt"], "left").drop("_salt")
