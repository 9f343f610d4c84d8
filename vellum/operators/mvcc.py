"""Versions of keys: visibility, retention, history and replay over (key, ver, deleted, value).

``ver`` orders the versions of a key; a delete is a version with ``deleted``. Per-key choices
are aggregates with a map-side part, so a key with very many versions does not land in one task
before it is reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each key, deletes included."""
    rest = [c for c in versions.columns if c not in ("key", "ver")]
    last = versions.groupBy("key").agg(F.max_by(F.struct("ver", *rest), "ver").alias("v"))
    return last.select("key", "v.*").select(*versions.columns)


def latest(versions: DataFrame) -> DataFrame:
    """The live entries: keys whose last version is not a delete."""
    return newest(versions).where("not deleted")


def as_of(versions: DataFrame, snap: str, history: DataFrame | None = None) -> DataFrame:
    """The live entries at a snapshot: versions up to it, hot and, if given, archived."""
    every = versions if history is None else versions.unionByName(history).dropDuplicates(["key", "ver"])
    return latest(every.where(F.col("ver") <= snap))


def version_bounds(versions: DataFrame, n: int = 32) -> list[str]:
    """At most n - 1 version ids that cut the versions into parts of about equal size.

    They are quantiles of the 1,024 ids with the least hash. Only the cut depends on them, not
    the result: every version falls in some part.
    """
    some = sorted(r[0] for r in versions.select("ver").distinct().orderBy(F.xxhash64("ver")).limit(1024).collect())
    return sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []


def part(ver: Column, bounds: list[str]) -> Column:
    """The number of the part that a version id falls in."""
    return sum((F.when(ver >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def as_of_each(lookups: DataFrame, versions: DataFrame) -> DataFrame:
    """For (key, snap) rows, the entry visible at each row's own snapshot; none if it is deleted.

    Lookups and versions of a key are read side by side in order, never paired. A key's rows are
    cut into parts by version, so that a hot key is many tasks; the last version of a part is
    handed on to the later ones, a row a part.
    """
    bounds = version_bounds(versions)
    state = F.struct("ver", "deleted", "value")
    v = versions.select("key", F.col("ver").alias("at"), F.lit(0).alias("ask"), state.alias("v"))
    q = lookups.select("key", F.col("snap").alias("at")).distinct().select("key", "at", F.lit(1).alias("ask"), F.lit(None).cast(v.schema["v"].dataType).alias("v"))
    rows = v.unionByName(q).withColumn("part", part(F.col("at"), bounds))
    w = Window.partitionBy("key", "part").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("ask = 1")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = rows.groupBy("key", "part").agg(F.max_by("v", F.when(F.col("ask") == 0, F.col("at"))).alias("last")).withColumn("old", F.last("last", ignorenulls=True).over(before))
    out = seen.join(handed.select("key", "part", "old"), ["key", "part"]).withColumn("v", F.coalesce("v", "old"))
    return out.where("not v.deleted").select("key", F.col("at").alias("snap"), "v.ver", "v.value")


def freeze(versions: DataFrame) -> DataFrame:
    """(snap): the id of the last version of all, a consistent snapshot."""
    return versions.agg(F.max("ver").alias("snap"))


def collapse(versions: DataFrame) -> DataFrame:
    """Runs of versions of a key with one value and state keep their newest.

    A hot key's versions are cut into parts; a part's last version is compared with the first of
    the next.
    """
    columns, same = versions.columns, F.struct("deleted", "value")
    rows = versions.withColumn("part", part(F.col("ver"), version_bounds(versions)))
    w = Window.partitionBy("key", "part").orderBy("ver")
    rows = rows.withColumn("after", F.lead(same).over(w))
    firsts = rows.groupBy("key", "part").agg(F.min_by(same, "ver").alias("first"))
    firsts = firsts.withColumn("beyond", F.lead("first").over(Window.partitionBy("key").orderBy("part")))
    rows = rows.join(firsts.select("key", "part", "beyond"), ["key", "part"]).withColumn("after", F.coalesce("after", "beyond"))
    return rows.where(F.col("after").isNull() | ~same.eqNullSafe(F.col("after"))).select(*columns)


def retain(versions: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(hot, moved): keep_all moves nothing, prune drops and archive moves all but live versions."""
    if policy == "keep_all":
        return versions, versions.limit(0)
    if policy not in ("prune", "archive"):
        raise ValueError(f"no such policy: {policy}")
    hot = latest(versions)
    cold = versions.join(hot.select("key", "ver"), ["key", "ver"], "left_anti").select(*versions.columns)
    return hot, cold if policy == "archive" else versions.limit(0)


def version_stats(versions: DataFrame) -> DataFrame:
    """(versions, keys, pruned): how many versions there are and a prune would drop."""
    per_key = versions.groupBy("key").agg(F.count("*").alias("n"), F.max_by("deleted", "ver").alias("gone"))
    return per_key.agg(F.sum("n").alias("versions"), F.count("*").alias("keys"), F.sum(F.col("n") - F.when(F.col("gone"), 0).otherwise(1)).alias("pruned"))


def gc_before(versions: DataFrame, least: str) -> DataFrame:
    """Versions from an id on; a key whose every version is older is lost, as asked."""
    return versions.where(F.col("ver") >= least)


def merge_history(hot: DataFrame, cold: DataFrame) -> DataFrame:
    return hot.unionByName(cold).dropDuplicates(["key", "ver"])


# replay of a log (seq, op, txn, key, ver, deleted, value)


def committed(log: DataFrame) -> DataFrame:
    """Writes outside a transaction, and those whose transaction has a commit marker."""
    done = log.where("op = 'commit'").select("txn").distinct()
    writes = log.where("op in ('put', 'del')")
    return writes.where("txn is null").unionByName(writes.join(done, "txn", "left_semi").select(*writes.columns))


def replay(log: DataFrame, after: int | Column | None = None) -> DataFrame:
    """The live entries after replaying the committed writes, from a sequence number on if given."""
    writes = committed(log)
    if after is not None:
        writes = writes.where(F.col("seq") > after)
    return latest(writes.select("key", "ver", "deleted", "value").dropDuplicates(["key", "ver"]))


def resume_point(log: DataFrame) -> DataFrame:
    """(after): the last checkpoint, 0 if there is none."""
    return log.where("op = 'checkpoint'").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("after"))


def gaps(log: DataFrame) -> DataFrame:
    """(after, next): holes in the sequence, without a global sort: a successor is looked up by join.

    Each number that has no successor, except the last, is followed by the least larger one.
    Numbers are compared within ranges of 100,000, which holes may span.
    """
    size = 100_000
    s = log.select("seq").distinct()
    bucket = F.expr(f"seq div {size}")
    edges = s.groupBy(bucket.alias("b")).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    w = Window.partitionBy("b").orderBy("seq")
    inner = s.withColumn("b", bucket).withColumn("next", F.lead("seq").over(w)).where("next > seq + 1").select(F.col("seq").alias("after"), "next")
    # one row a range: the few rows of this window are the ranges, not the log
    across = edges.withColumn("next", F.lead("lo").over(Window.orderBy("b"))).where("next > hi + 1").select(F.col("hi").alias("after"), "next")
    return inner.unionByName(across)


def cut_at_gap(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): the log before its first hole, and the rest."""
    first = gaps(log).agg(F.min("after").alias("cut"))
    both = log.join(F.broadcast(first))  # one row
    keep = F.col("cut").isNull() | (F.col("seq") <= F.col("cut"))
    return both.where(keep).drop("cut"), both.where(~keep).drop("cut")


def truncate(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): the log after its last checkpoint, and what a replay no longer needs."""
    both = log.join(F.broadcast(resume_point(log)))  # one row
    return both.where("seq > after").drop("after"), both.where("seq <= after").drop("after")
