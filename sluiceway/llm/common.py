"""Helpers shared by the training-data operators: scratch tables and word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's hash memo before it is emptied (about 60 MB).
MEMO_WORDS = 400_000
#: Keys that are joined apart from the rest since they hold many rows, at most.
MOST_HOT = 10_000
#: With this set a write's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges for each part of the tables of connected components.
EDGES_PER_PART = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it names none, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sluiceway-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared checkpoint folder, which cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/sluiceway-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Deletes these tables; nothing that is still read may come from them."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            self.names.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Keeps this table and deletes all others."""
        kept = self.keep(df, name)
        self.free(*(self.names - {name}))
        return kept


def fresh(name: str, *taken: list[str]) -> str:
    """This name, with as many underscores before it as it takes to clash with none of those taken; case does not count."""
    known = {c.lower() for names in taken for c in names}
    while name.lower() in known:
        name = f"_{name}"
    return name


def only(rows: DataFrame, ids: DataFrame, on: list[str], limit: int = 1_000_000) -> DataFrame:
    """The rows whose key is among ids; these are broadcast only where a count proves them few."""
    return rows.join(F.broadcast(ids) if ids.count() <= limit else ids, on, "left_semi")


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with keyed, which holds each key once and, as n, in how many of the `total` rows it lies.

    Keys of more than one in MOST_HOT rows, which are MOST_HOT at most, are broadcast, so that no task gets
    all rows of one; the others are joined by a shuffle. Both tables are read several times.
    """
    least = max(64, total // MOST_HOT)
    hot = keyed.where(F.col("n") > least)
    if hot.isEmpty():
        return rows.join(keyed.drop("n"), on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col("n") <= least).drop("n"), on)
    return rows.join(F.broadcast(hot.drop("n")), on).unionByName(cold)


def trim() -> None:
    """Hands back to the system what earlier tasks of this worker, which lives on between them, have freed but hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


class WordHasher(dict):
    """word -> 64-bit hash, remembered for the words that a worker has seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; only A-Z are lower-cased. bytes.split() parts at just these six bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a combined hash counts."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` word hashes; for fewer words, of the whole sequence; empty for none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(size))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", least: bool = True) -> DataFrame:
    """(u, v) long edges -> (node, component): the least node that each node reaches; some node of these unless `least`.

    Every round hooks each node to the neighbour that a hash of the round puts first, and contracts the
    graph; the hash makes a round shrink chains, stars and cliques alike by a share of their nodes.
    Nothing is gathered for a node but a minimum, so hubs cost a partial aggregate and a join that AQE can
    split. Tables are written in as many parts as the edges left in the round ask for.
    """
    spark = scratch.spark
    edges = scratch.keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-e0")
    mapping: DataFrame | None = None
    k = nodes = 0
    while left := edges.count():
        parts = 2 + left // EDGES_PER_PART
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("node"))
        first = both.groupBy("u").agg(F.min(place("v")).alias("m"))
        hook = first.select("u", F.least("m", place("u"))["node"].alias("m"))
        hook = scratch.keep(hook.coalesce(parts), f"{name}-h{k}")
        above = hook.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        hook = scratch.keep(hook.join(above, "m").select("u", F.col("mm").alias("m")).coalesce(parts), f"{name}-j{k}")
        to_u, to_v = hook, hook.select(F.col("u").alias("v"), F.col("m").alias("n"))
        shrunk = edges.join(to_u, "u").join(to_v, "v").where("m <> n").select(F.least("m", "n").alias("u"), F.greatest("m", "n").alias("v")).distinct()
        edges = scratch.keep(shrunk.coalesce(parts), f"{name}-e{k + 1}")
        if mapping is None:
            mapping, nodes = hook.select(F.col("u").alias("node"), F.col("m").alias("component")), parts
        else:
            step = hook.select(F.col("u").alias("component"), "m")
            moved = mapping.join(step, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
            mapping = scratch.keep(moved.coalesce(nodes), f"{name}-m{k}")
        k += 1
    if mapping is None:
        return spark.createDataFrame([], "node long, component long")
    if least:
        low = mapping.groupBy("component").agg(F.min("node").alias("low"))
        mapping = scratch.keep(mapping.join(low, "component").select("node", F.col("low").alias("component")), f"{name}-least")
    return mapping
