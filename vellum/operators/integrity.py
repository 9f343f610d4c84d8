"""Content hashes, canonical rows, and comparison of two copies of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_store(df: DataFrame, value: str) -> DataFrame:
    """(hash, value, copies): one copy of each content, by its SHA-256."""
    return df.where(F.col(value).isNotNull()).groupBy(F.sha2(F.col(value).cast("binary"), 256).alias("hash")).agg(F.first(value).alias("value"), F.count("*").alias("copies"))


def _tagged(name: str, kind: str) -> Column:
    tag = "1" if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else "2" if kind in ("float", "double") or kind.startswith("decimal") else "4" if kind == "binary" else "3"
    c = F.col(name)
    text = F.lower(F.hex(c)) if kind == "binary" else c.cast("string")
    return F.coalesce(F.concat(F.lit(tag + ":"), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("0:"))


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """An injective text of a row: each column, by name, as name, type tag, length and bytes."""
    kinds = dict(df.dtypes)
    return F.concat(*[F.concat(F.lit(f"{len(c)}:{c}="), _tagged(c, kinds[c]), F.lit(";")) for c in sorted(columns or df.columns)])


def row_hashes(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key and the digest of each row's canonical text."""
    return df.select(*key, F.sha2(canonical_row(df), 256).alias("row_hash"))


def encode_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A composite key as one text: type tag, length and bytes of each part."""
    kinds = dict(df.dtypes)
    return F.concat(*[F.concat(_tagged(c, kinds[c]), F.lit(";")) for c in columns])


def decode_key(encoded: Column, parts: int) -> list[Column]:
    """The parts of an encoded key as text; null parts as null."""
    step = F.struct(encoded.cast("binary").alias("rest"), F.array().cast("array<string>").alias("out"))  # lengths are in bytes

    def cut(acc, _):
        rest = acc["rest"]
        begin = F.substring(rest, 1, 24).cast("string")
        null, n = F.startswith(begin, F.lit("0:;")), F.regexp_extract(begin, "^[0-9]:([0-9]+):", 1)
        part = F.struct(rest.alias("rest"), F.when(null, F.lit(0)).otherwise(F.length(n) + 3).alias("head"), F.when(~null, n.try_cast("int")).alias("size"))
        done = lambda p: F.struct(
            F.when(p["size"].isNull(), F.substring(p["rest"], F.lit(4), F.length(p["rest"]))).otherwise(F.substring(p["rest"], p["head"] + p["size"] + 2, F.length(p["rest"]))).alias("rest"),
            F.concat(acc["out"], F.array(F.when(p["size"].isNotNull(), F.substring(p["rest"], p["head"] + 1, p["size"]).cast("string")))).alias("out"),
        )
        return F.get(F.transform(F.array(part), done), 0)

    # one expression for all parts: it does not grow with their number
    every = F.aggregate(F.sequence(F.lit(1), F.lit(parts)), step, cut, lambda acc: acc["out"])
    return [F.get(every, i) for i in range(parts)]


def count_rows(**tables: DataFrame) -> DataFrame:
    """(name, n) of each copy."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def differences(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key and what is wrong: missing in a or b, or the first column that differs by name."""
    others = sorted(c for c in a.columns if c not in key)
    side = lambda df, p: df.select(*key, F.struct(*others).alias(p), F.lit(True).alias(f"in_{p}"))
    j = side(a, "a").join(side(b, "b"), list(key), "full_outer")
    first = F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in others]) if others else F.lit(None)
    what = F.when(F.col("in_a").isNull(), "missing in a").when(F.col("in_b").isNull(), "missing in b").otherwise(first)
    return j.select(*key, what.alias("difference")).where("difference is not null")


def shard_histogram(keys: DataFrame, shard: Column) -> DataFrame:
    return keys.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


def chi_square(histogram: DataFrame, cells: int) -> DataFrame:
    """(chi2, n): how uneven a histogram over ``cells`` cells is; cells without keys count."""
    t = histogram.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return t.select((F.col("sq") * cells / F.col("n") - F.col("n")).alias("chi2"), "n")


def table_stats(entries: DataFrame) -> DataFrame:
    """(entries, key_bytes, value_bytes, large): sizes from the stored lengths; values are not read."""
    return entries.agg(F.count("*").alias("entries"), F.sum(F.octet_length("key").cast("long")).alias("key_bytes"), F.sum(F.col("value_len").cast("long")).alias("value_bytes"), F.count_if(F.col("value_len") > 2048).alias("large"))


def migrate(shard: Column, source: int, target: int) -> Column:
    """Shard numbers with one shard's keys moved to another."""
    return F.when(shard == source, F.lit(target)).otherwise(shard)
