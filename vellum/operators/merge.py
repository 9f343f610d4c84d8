"""Three-way merging, unions of sorted sets, and block deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, ver, val_crc, deleted, side, conflict) from sides of (key, ver, val_crc, deleted).

    Keys are unique in a side. A side changed a row if its val_crc or deleted differs from the
    base. One changed side wins; both changed alike: ours; both changed otherwise: the higher
    ver, theirs only if it is higher, and a conflict. A row that one side dropped stays out if
    the other left it alone; if the other changed it, the change wins, with a conflict. Two full
    joins on the key share one partitioning.
    """
    side = lambda df, p: df.select("key", F.struct("ver", "val_crc", "deleted").alias(p))
    j = side(base, "b").join(side(ours, "o"), "key", "full_outer").join(side(theirs, "t"), "key", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    same = lambda x, y: x["val_crc"].eqNullSafe(y["val_crc"]) & x["deleted"].eqNullSafe(y["deleted"])
    both = o.isNotNull() & t.isNotNull()
    o_mut, t_mut = ~same(o, b), ~same(t, b)
    newer = F.when(same(o, t), "ours").when(t["ver"] > o["ver"], "theirs").otherwise("ours")
    won = (
        F.when(b.isNull() & both, newer)
        .when(b.isNull(), F.when(o.isNotNull(), "ours").otherwise("theirs"))
        .when(both & o_mut & t_mut, newer)
        .when(both, F.when(o_mut, "ours").when(t_mut, "theirs").otherwise("base"))
        .when(o.isNotNull() & o_mut, "ours")
        .when(t.isNotNull() & t_mut, "theirs")
    )
    clash = F.when(both & (b.isNull() | (o_mut & t_mut)), ~same(o, t)).when(both | b.isNull(), False).otherwise(True)
    picked = F.when(F.col("side") == "ours", o).when(F.col("side") == "theirs", t).otherwise(b)
    out = j.withColumns({"side": won, "conflict": clash}).where("side is not null").withColumn("p", picked)
    return out.select("key", "p.ver", "p.val_crc", "p.deleted", "side", "conflict")


def union_sorted(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of either set, once each."""
    return a.unionByName(b).distinct()


def delta_encode(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(block_no, data): blocks of dst that differ from src; null data where dst has no block."""
    j = src.select("block_no", F.col("data").alias("s")).join(dst.select("block_no", F.col("data").alias("d")), "block_no", "full_outer")
    return j.where(~F.col("s").eqNullSafe(F.col("d"))).select("block_no", F.col("d").alias("data"))


def image_hash(blocks: DataFrame) -> DataFrame:
    """(hash): order-independent digest of an image: the sum of its blocks' hashes."""
    return blocks.agg(F.sum(F.xxhash64("block_no", "data").cast("decimal(38,0)")).alias("hash"))


class DeltaMismatch(ValueError):
    """An image is not the one that a delta was made from, or made."""


def delta_apply(src: DataFrame, delta: DataFrame, src_hash=None, dst_hash=None) -> DataFrame:
    """src with the delta's blocks laid over it; given hashes are verified before and after."""
    if src_hash is not None and image_hash(src).first()[0] != src_hash:
        raise DeltaMismatch("source")
    d = delta.select("block_no", F.col("data").alias("d"), F.lit(True).alias("hit"))
    out = src.select("block_no", F.col("data").alias("s")).join(d, "block_no", "full_outer")
    out = out.select("block_no", F.when(F.col("hit"), F.col("d")).otherwise(F.col("s")).alias("data")).where("data is not null")
    if dst_hash is not None and image_hash(out).first()[0] != dst_hash:
        raise DeltaMismatch("result")
    return out


def split_blocks(df: DataFrame, id: str, value: str, size: int = 4096) -> DataFrame:
    """(id, block_no, data): a value in blocks; blocks of zeros are left out and read back as zeros."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("v") / size).cast("int"))
    b = df.select(F.col(id), F.col(value).cast("binary").alias("v")).select(id, "v", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
    b = b.select(id, "block_no", F.substring("v", F.col("block_no") * size + 1, F.lit(size)).alias("data"))
    return b.where(F.length(F.replace(F.hex("data"), F.lit("0"), F.lit(""))) > 0)


def join_blocks(blocks: DataFrame, sizes: DataFrame, id: str, size: int = 4096) -> DataFrame:
    """(id, value): blocks in order, missing ones as zeros, cut to each file's ``bytes``."""
    want = sizes.select(id, "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((bytes - 1) div {size} as int)")))).alias("block_no"))
    zero: Column = F.unhex(F.lit("00" * size))
    full = want.join(blocks, [id, "block_no"], "left").withColumn("data", F.coalesce("data", zero))
    return full.groupBy(id).agg(F.first("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("block_no", "data"))).alias("p")).select(id, F.substring(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""), F.lit(1), (F.col("bytes") * 2).cast("int")).alias("h")).select(id, F.unhex("h").alias("value"))
