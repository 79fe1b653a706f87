"""What the corpus operators share: written scratch tables, hot-safe joins, and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 8-byte keys that may be broadcast (about 64 MB in the JVM); above it the join shuffles.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker, where the session doesn't say: a worker's memory goes with it, as does the JVM's beside its heap.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def release() -> None:
    """Give memory that numpy and Arrow have freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


class Scratch:
    """Tables written under ``spark.checkpoint.dir``: they cut lineage, and every executor can read them again.

    A folder is set only where the session names none (tests, local runs).  What is written goes away with
    ``drop`` or when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
        self.root = f"{root.rstrip('/')}/fabriq-{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)
        small_batches(spark)

    def _fs(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, tidy: bool = False) -> DataFrame:
        """Write df and return it as read back.  tidy: let Spark free the shuffles that only df still needed."""
        self._count += 1
        where = f"{self.root}/{self._count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        schema = df.schema
        del df
        if tidy:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if where := getattr(df, "_scratch_path", None):
                path, fs = self._fs(where)
                fs.delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_KEYS) -> bool:
    """Whether a table of keys is within the broadcast bound; reads rows+1 at most."""
    return df.limit(rows + 1).count() <= rows


def semi_size(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, marked for broadcast if it has ``rows`` rows at most."""
    return F.broadcast(df) if small(df, rows) else df


def fresh_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """A name for each of names: its own, or with leading underscores where that is among taken or already given away."""
    out: dict[str, str] = {}
    for name in names:
        new = name
        while new in taken or new in out.values() or (new != name and new in names):
            new = f"_{new}"
        out[name] = new
    return out


def semi(left: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """left rows whose ``on`` is (left_anti: is not) among keys: by broadcast within BROADCAST_KEYS, else by shuffle."""
    return left.join(F.broadcast(keys) if small(keys) else keys, on, how)


def buckets(spark: SparkSession, per: int = 2) -> int:
    """Hash buckets for a custom exchange: they follow the session's shuffle partitions."""
    return per * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000, rows: int = 5_000):
    """Parts of a batch of about ``most`` bytes of text, one row at least."""
    at, n = 0, batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    while at < n:
        end, total = at, 0
        while end < n and end - at < rows and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end
    release()


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 200, one_task: int = 200_000) -> DataFrame:
    """(id, component): component is the smallest id reachable.  Only ids that have an edge are returned.

    Large-star / small-star contraction over written tables.  Before the first round each partition
    replaces its edges by a spanning star of what they connect, so a hot centre's edges shrink where they
    are; minima are pre-aggregated before they are shuffled, and no neighbour list is gathered.
    """
    spark = scratch.spark
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def flush():
            xs = list(parent)
            rows = arrow_rows(schema, u=xs, v=[find(x) for x in xs])
            parent.clear()
            return rows

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:  # what is connected so far goes out as a star; the rest goes on
                yield flush()
        if parent:
            yield flush()

    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    nodes = None
    e = scratch.save(e.mapInArrow(contract, "u long, v long").distinct())
    if e.count() <= one_task:
        return scratch.save(e.coalesce(1).mapInArrow(contract, "u long, v long").select(F.col("u").alias("id"), F.col("v").alias("component")))
    state = None
    for _ in range(rounds):
        # every node points at the smallest neighbour of its own (large star), then at the smallest of what it points at
        both = e.where("u != v")
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(e.where("u = v")).distinct()
        down = large.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        nxt = scratch.save(star.union(low.select("u", F.col("m").alias("v"))).union(e.where("u = v")).distinct())
        total = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum((F.col("u") != F.col("v")).cast("int"))).first()
        if nodes is not None:
            scratch.drop(e)
        nodes, e = True, nxt
        if tuple(total) == state:
            break
        state = tuple(total)
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
