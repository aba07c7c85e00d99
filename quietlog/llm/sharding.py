"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row has a number in 0 .. N-1. A keyed Feistel network on a mixed-radix domain a x b, the
smallest near-square that holds N, permutes the numbers; a value of N or more is permuted again until it
falls below N (cycle walking), so what is left is a bijection of 0 .. N-1. The permuted number p
gives shard p mod n and slot p div n: shard sizes differ by one row at most, the order is a shuffle
that anyone can recompute from the seed, and shard and slot of a row are found without a sort.

Numbering without a global sort: rows fall into a constant number of hash buckets, one small table of
bucket counts gives each bucket's first number, and rows are numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65536
ROUNDS = 6
WALKS = 64


def feistel(x: str, a: str, b: str, seed: int, rounds: int = ROUNDS) -> str:
    """SQL of one pass of the network over x in [0, a*b): the halves take turns, each shifted by a hash of the other."""
    state = f"struct({x} div {b} as l, {x} % {b} as r)"
    keys = ", ".join(str(seed * 1000 + k) for k in range(rounds))
    step = (
        f"case when k % 2 = 0 then struct((s.l + pmod(xxhash64(s.r, k), {a})) % {a} as l, s.r as r) "
        f"else struct(s.l as l, (s.r + pmod(xxhash64(s.l, k), {b})) % {b} as r) end"
    )
    return f"aggregate(array({keys}), {state}, (s, k) -> {step}, s -> s.l * {b} + s.r)"


def permuted(df: DataFrame, number: str, total: str, seed: int, to: str) -> DataFrame:
    """df with column to: the permuted number. Walks on while the value is not below total; a value that
    has not landed after WALKS passes (never seen: a pass misses with a chance of 1/sqrt(N)) is an error, not a guess."""
    a, b = "feistel_a", "feistel_b"
    df = df.withColumn(a, F.expr(f"cast(greatest(1, ceil(sqrt({total}))) as bigint)")).withColumn(b, F.expr(f"cast(greatest(1, ceil({total} / {a})) as bigint)"))
    df = df.withColumn(to, F.expr(feistel(number, a, b, seed)))
    walk = feistel("p", a, b, seed)
    df = df.withColumn(to, F.expr(f"case when {to} < {total} then {to} else aggregate(sequence(1, {WALKS}), {to}, (p, i) -> case when p < {total} then p else {walk} end) end"))
    return df.withColumn(to, F.expr(f"case when {to} < {total} then {to} else raise_error('cycle walk did not land') end")).drop(a, b)


def numbered(df: DataFrame, keys: list[str], number: str, total: str) -> DataFrame:
    """df with gapless row numbers from 0 and the row count, in an order that the keys decide.

    Rows with equal keys are numbered in any order among themselves; a repeated key cannot overload a task
    unless all key columns repeat, so keys should hold all that tells rows apart."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    counts = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows_in"))  # BUCKETS rows at most, however large df is
    every = Window.partitionBy(F.lit(0))
    firsts = counts.select(
        F.col("bucket"),
        (F.sum("rows_in").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows_in")).alias("first_in"),
        F.sum("rows_in").over(every).alias(total),
    )
    inside = Window.partitionBy("bucket").orderBy(*keys)
    df = df.withColumn("row_in", F.row_number().over(inside) - 1)
    return df.join(F.broadcast(firsts), "bucket").withColumn(number, (F.col("first_in") + F.col("row_in")).cast("long")).drop("bucket", "row_in", "first_in")


def shard(docs: DataFrame, n_shards: int, seed: int = 20260, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Places every row of docs: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null), row_number.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and crc32 0, as an empty one. A null doc_id
    is a row like any other. Repeated rows get a place each. Equal texts, the groups, are not held together:
    under this law a group of a third of all rows could not fit one shard. Other columns are not read, so names
    that clash with ours do no harm. No rows in, no rows out."""
    bare = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(bare) + 1).cast("long").alias("size"), F.crc32(bare.cast("binary")).alias("text_crc32"))
    rows = permuted(numbered(rows, ["doc_id", "text_crc32", "size"], "row_number", "total"), "row_number", "total", seed, "place")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op3_feistel_shards(spark, sf_dir):
    """Shards 0 to 7 of all documents."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
