"""Cutting the lineage of loops: tables written under spark.checkpoint.dir, which all executors share.

Spark plans joins by the sizes of files, and the tables of loops are so regular that a few MB of them hold millions of rows; so a table is
joined by broadcast only with a count that allows it.
"""

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


#: Rows of a written table, and bytes of a supplied one, up to which Spark may choose to broadcast it.
ROWS, BYTES = 100_000, 1 << 20


def large(df: DataFrame) -> DataFrame:
    """df, not to be broadcast, nor what selects, filters or groups it; an explicit F.broadcast of either goes before."""
    return df.hint("merge")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, written and read back, and its number of rows, which the write itself counts."""
    out = cut(df)
    return out, out._rows


def cut(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """df, written and read back; drop: an earlier result of cut() that nothing needs any more."""
    rows = Observation()
    schema, df = df.schema, df.observe(rows, F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    where = f"{root.rstrip('/')}/fabriq-loop-{uuid.uuid4().hex}"
    df.write.parquet(where)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(conf).deleteOnExit(path)
    n = rows.get["n"]
    out = spark.read.schema(schema).parquet(where)
    out = out if n <= ROWS else large(out)
    out._cut, out._rows = where, n
    if drop is not None and getattr(drop, "_cut", None):
        old = jvm.org.apache.hadoop.fs.Path(drop._cut)
        old.getFileSystem(conf).delete(old, True)
    return out
