"""Digests of tables as sets of rows: equal for equal rows in any order, files or partitions, and from sums alone.

A row is 128 bits of a hash of its columns, in the order of their names, written so that types, nulls and texts cannot be taken for one another. A
table's digest is the number of its rows and four sums, of 32 bits each of the rows' hashes, modulo 2**61 - 1; so parts add up to the whole, repeated rows
count, and nothing is sorted. What a writer was given, what stands in its files, and the parts of it can be compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Mersenne prime.
PRIME = (1 << 61) - 1


def row_hash(df: DataFrame) -> Column:
    """Four parts of 32 bits of a row's hash, as an array."""
    named = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    kinds = F.lit(",".join(f"{c}:{t}" for c, t in sorted(df.dtypes)))
    digest = F.sha2(F.concat(kinds, F.lit("\n"), named), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(10,0)") for k in range(4)])


def set_digests(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, digest) of the rows of each group, or of all; a table without rows has the digest 0."""
    parts = df.select(*(by or []), row_hash(df).alias("_h"))
    sums = parts.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.col("_h")[k]), F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"_{k}") for k in range(4)])
    return sums.select(*(by or []), "n", F.concat_ws("-", *[F.lower(F.lpad(F.hex((F.col(f"_{k}") % F.lit(PRIME).cast("decimal(20,0)")).cast("bigint")), 16, "0")) for k in range(4)]).alias("digest"))


def lineage(source: DataFrame, outputs: dict[str, DataFrame], split: str | None = None) -> DataFrame:
    """(role, name, n, digest): the input, each output as it is read again, and each split of an output that has the column."""
    out = set_digests(source).select(F.lit("input").alias("role"), F.lit("input").alias("name"), "n", "digest")
    for name, df in outputs.items():
        out = out.unionByName(set_digests(df).select(F.lit("output").alias("role"), F.lit(name).alias("name"), "n", "digest"))
        if split and split in df.columns:
            out = out.unionByName(set_digests(df, [split]).select(F.lit("split").alias("role"), F.concat(F.lit(f"{name}/"), F.coalesce(F.col(split).cast("string"), F.lit(""))).alias("name"), "n", "digest"))
    return out
