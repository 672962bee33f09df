"""A lossless log with a ledger, and a re-sync that moves only what differs.

The log. A batch goes to ``data/bucket=b/epoch=e``, a bucket by the hash of the key, and only then is its entry put into the ledger, a small
file that is created under its final name once. An epoch with an entry is never written again; what a torn batch left is overwritten by its
next attempt, and readers see entered epochs only. A row whose key is there already isn't added. To know that, a batch reads the keys of those parts only whose range of keys,
by the ledger, meets its own in the same bucket: for keys that grow that is none, however large the log has become.

The re-sync. Both sides are summed up to digests of hash ranges of the key: row count, exclusive or and sum of row hashes. Digests of wide
ranges are sums of those of narrow ones, so the sides are compared level by level, and only ranges that differ go on. Rows of the ranges that differ at the last level
are read and compared by key.

Null keys are one key. In the log, of rows of one key in a batch one stays. In the re-sync keys are unique on either side.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> dict[int, list[dict]]:
    """The ledger: for each entered epoch its parts (bucket, low, high, n)."""
    at, fs = _path(spark, f"{path}/ledger")
    if not fs.exists(at) or not fs.listStatus(at):
        return {}
    rows = spark.read.schema("epoch long, parts array<struct<bucket:int,low:string,high:string,n:long>>").json(f"{path}/ledger").collect()
    return {r.epoch: [p.asDict() for p in r.parts] for r in rows}


def _enter(spark: SparkSession, path: str, epoch: int, parts: list[dict]) -> None:
    at, fs = _path(spark, f"{path}/ledger/epoch-{epoch:012d}.json")
    part, _ = _path(spark, f"{path}/ledger/_epoch-{epoch:012d}.json")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"epoch": epoch, "parts": parts}).encode()))
    out.close()
    if not fs.rename(part, at):
        raise OSError(f"the entry of epoch {epoch} can't be written")


def _ranked(key: str) -> Column:
    """A key as text that sorts as the key does: whole numbers of any sign have one width."""
    return F.coalesce(F.expr(f"CASE WHEN try_cast(`{key}` AS bigint) IS NULL THEN concat('~', cast(`{key}` AS string)) ELSE lpad(cast(cast(try_cast(`{key}` AS bigint) AS decimal(20, 0)) + 9223372036854775808BD AS string), 20, '0') END"), F.lit(""))


def writer(path: str, key: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], int]:
    """A foreachBatch function; gives the number of older parts that it read."""

    def write(batch: DataFrame, epoch: int) -> int:
        spark = batch.sparkSession
        known = entries(spark, path)
        if epoch in known:
            return 0
        d = batch.withColumn("_rank", _ranked(key)).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(_rank), {buckets}) AS int)")).dropDuplicates(["_rank"])
        spans = {r.bucket: r for r in d.groupBy("bucket").agg(F.min("_rank").alias("low"), F.max("_rank").alias("high")).collect()}
        met = sorted({(p["bucket"], e) for e, parts in known.items() for p in parts if (s := spans.get(p["bucket"])) and p["low"] <= s.high and s.low <= p["high"]})
        if met:
            older = spark.read.parquet(*[f"{path}/data/bucket={b}/epoch={e}" for b, e in met]).select(_ranked(key).alias("_rank")).distinct()
            d = d.join(older, "_rank", "left_anti")
        _, fs = _path(spark, path)
        own = lambda b: f"{path}/data/bucket={b}/epoch={epoch}"
        for b in range(buckets):  # what a torn attempt left
            fs.delete(_path(spark, own(b))[0], True)
        d.withColumn("epoch", F.lit(epoch)).repartition("bucket").write.mode("append").partitionBy("bucket", "epoch").parquet(f"{path}/data")
        made = [own(b) for b in spans if fs.exists(_path(spark, own(b))[0])]
        parts = []
        if made:
            bucket = F.expr(f"cast(pmod(xxhash64(_rank), {buckets}) AS int)").alias("bucket")
            rows = spark.read.parquet(*made).groupBy(bucket).agg(F.min("_rank").alias("low"), F.max("_rank").alias("high"), F.count(F.lit(1)).alias("n"))
            parts = [r.asDict() for r in rows.collect()]
        _enter(spark, path, epoch, parts)
        return len(met)

    return write


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of entered epochs. Files are those that the ledger names."""
    known = entries(spark, path)
    named = [f"{path}/data/bucket={p['bucket']}/epoch={e}" for e, parts in sorted(known.items()) for p in parts]
    if not named:
        raise ValueError(f"{path} has no entered rows")
    return spark.read.option("basePath", f"{path}/data").parquet(*named).drop("_rank")


def digests(df: DataFrame, keys: list[str], columns: list[str], bits: int) -> DataFrame:
    """(part, n, x, s): count, exclusive or and sum of row hashes of each of 2 ** bits ranges of the keys' hashes; as many rows at most."""
    d = df.select(F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).alias("part"), F.xxhash64(*keys, *columns).alias("_h"))
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("s"))


def _coarser(d: DataFrame, by: int) -> DataFrame:
    return d.groupBy(F.shiftrightunsigned("part", by).alias("part")).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def differing(a: DataFrame, b: DataFrame, bits: int, step: int = 4) -> DataFrame:
    """(part): the ranges whose digests differ, compared from wide ranges to narrow ones; ``a`` and ``b`` are digests."""
    suspect = None
    for level in range(step, bits + step, step):
        level = min(level, bits)
        one, two = (_coarser(d, bits - level) for d in (a, b))
        both = one.alias("a").join(two.alias("b"), "part", "full").where("NOT (a.n <=> b.n AND a.x <=> b.x AND a.s <=> b.s)").select("part")
        if suspect is not None:
            wide = suspect.select(F.col("part").alias("_wide"))
            both = both.join(F.broadcast(wide), F.shiftrightunsigned("part", level - last) == F.col("_wide"), "left_semi")  # at most 2 ** bits rows
        suspect, last = both, level
    return suspect


def changes(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], bits: int = 12) -> DataFrame:
    """(keys, what, columns): what makes ``target`` equal to ``source``: 'insert' and 'update' with the source's columns, 'delete' without.

    Only rows of ranges that differ are moved; with ``bits`` near the logarithm of the rows, those are few more than the rows that differ.
    """
    parts = differing(digests(source, keys, columns, bits), digests(target, keys, columns, bits), bits)
    some = lambda d: d.select(*keys, *columns, F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits).alias("part")).join(F.broadcast(parts), "part", "left_semi").drop("part")
    one = some(source).select(*keys, F.struct(*columns).alias("_new"))
    two = some(target).select(*keys, F.struct(*columns).alias("_old"))
    same = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = one.alias("a").join(two.alias("b"), same, "full").where("NOT (_new <=> _old)")
    what = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], what.alias("what"), *[F.col(f"_new.{c}").alias(c) for c in columns])
