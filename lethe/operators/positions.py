"""Exact global positions without a single-partition window.

A deterministic position is what a sequential loader gives (file order,
shuffled order, vocabulary rank).  ``row_number()`` over an unpartitioned
window would pull every row into one task, so positions are built from
counts of ordered buckets instead:

* hash order (``md5`` of a seed and the key): the leading hex digits of the
  hash are the bucket.  Buckets are uniform for distinct keys and fixed by
  the data, so a retried task lands in the same bucket.  Per-bucket counts
  give running offsets; rows are numbered only inside their bucket.
* value order (names, counts, steps): a range-partitioned, sorted copy is
  written once, which freezes partition ids and in-partition order; the
  per-partition counts give offsets and ``monotonically_increasing_id``
  carries the in-partition index.
* shuffled order of numbered rows: a bijection of 0..n-1 with a seed
  (``permuted``), a formula on a row's number: no sort, whatever the epochs.

Group and key columns may be null (a null is a key of its own) and repeated.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.functions.arrays import let
from lethe.session import frozen

# Leading hex digits of a hash that form a bucket: at most 65,536 buckets a
# group, which is the size of the offset table, and as many tasks' worth of rows.
BUCKET_DIGITS = 4
# Exact accumulator type of running sums.
EXACT = "decimal(38,18)"
# Values from here on are summed as floating point beside the exact sum.
LARGE = 1e12
# Rounds of the permutation, and the prime that its round function works in.
ROUNDS = 6
PRIME = (1 << 31) - 1


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner equi join on ``cols`` where a null matches a null; the columns
    come once, from the left side."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    on = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(other, on).drop(*[f"_r_{c}" for c in cols])


def seeded_hash(*parts) -> Column:
    """``md5(p1 ':' p2 ':' ...)`` as lower-case hex (same in DuckDB)."""
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def bucket_offsets(df: DataFrame, bucket: str, group_cols: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """Per (group, bucket): ``cnt``, ``off`` (rows in earlier buckets) and
    ``n`` (rows in the group).  Size: groups x buckets, not data.  With
    ``times`` a row counts as so many."""
    counts = df.groupBy(*group_cols, bucket).agg(
        (F.count(F.lit(1)) if times is None else F.sum(times)).alias("cnt"))
    w_before = (Window.partitionBy(*group_cols).orderBy(bucket)
                .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*group_cols)
    return (counts
            .withColumn("off", F.coalesce(F.sum("cnt").over(w_before), F.lit(0)).cast("long"))
            .withColumn("n", F.sum("cnt").over(w_all).cast("long")))


def hash_positions(df: DataFrame, hash_col: str, tie_cols: Sequence[str],
                   group_cols: Sequence[str] = (), prefix: int = BUCKET_DIGITS,
                   pos_col: str = "pos") -> DataFrame:
    """0-based position of each row inside its group, ordered by
    (``hash_col``, ``tie_cols``).  Adds ``pos_col`` and ``n``.  Give it keys,
    not payload: all its rows are shuffled."""
    b = "_bucket"
    x = df.withColumn(b, F.substring(F.col(hash_col), 1, prefix))
    offs = bucket_offsets(x, b, group_cols).select(*group_cols, b, "off", "n")
    joined = join_null_safe(x, offs, [*group_cols, b])
    w = Window.partitionBy(*group_cols, b).orderBy(hash_col, *tie_cols)
    return (joined.withColumn(pos_col, F.col("off") + F.row_number().over(w) - 1)
            .drop(b, "off"))


def frozen_order(df: DataFrame, order_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``order_cols`` (nulls first) over range partitions,
    written once: ``_pid`` numbers the ranges in order, ``_mid`` rises with
    the order.  A hot value, also one whole row repeated very often, is split
    over ranges (rows equal in all order columns follow in no set order)."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return frozen(tied.repartitionByRange(n, *order_cols, "_tie").sortWithinPartitions(*order_cols, "_tie").drop("_tie")
                  .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "order")


def ordered_positions(df: DataFrame, order_cols: Sequence[str], pos_col: str = "pos",
                      num_partitions: int | None = None, total_col: str | None = None) -> DataFrame:
    """0-based dense global position in ``order_cols`` order, and with
    ``total_col`` the number of rows: a surrogate key that does not need the
    columns to be unique or non-null (see ``frozen_order``)."""
    ranged = frozen_order(df, order_cols, num_partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # Bounded: one row per range partition.
    offs = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(Window.partitionBy()).alias("_all"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = ranged.join(F.broadcast(offs), "_pid").withColumn(pos_col, (F.col("_off") + local).cast("long"))
    if total_col is not None:
        out = out.withColumn(total_col, F.col("_all").cast("long"))
    return out.drop("_pid", "_mid", "_off", "_all")


def permutation_keys(*seed) -> list[int]:
    """3 numbers below PRIME for each round: 28-bit pieces of md5 digests of
    the seed's parts and the round's number."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.md5(":".join(map(str, (*seed, k))).encode()).hexdigest()
        out += [int(digest[7 * i:7 * i + 7], 16) for i in range(3)]
    return out


def permute(df: DataFrame, pos_col: str, n_col: str, keys_col: str, out_col: str) -> DataFrame:
    """Adds ``out_col``: the place of position ``pos_col`` in a shuffled order
    of 0..``n_col`` - 1, a bijection chosen by ``keys_col`` (an array, see
    ``permutation_keys``).

    A position is a cell of a grid of a x b >= n cells, a = ceil(sqrt(n)).
    Rounds shift the cell's row by a function of its column (modulo a) and
    its column by one of its row (modulo b) in turn, so each can be undone.
    A cell beyond n is walked on until it is inside; fewer than a cells are
    beyond, so the walk ends within that many steps, and few rows walk."""
    key = lambda i: F.get(F.col(keys_col), F.lit(i))
    x = (df.withColumn("_n", F.col(n_col).cast("long"))
         .withColumn("_a", F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(F.col("_n").cast("double"))).cast("long")))
         .withColumn("_b", F.expr("(_n + _a - 1) div _a"))
         .withColumn("_l", F.expr(f"`{pos_col}` % _a")).withColumn("_r", F.expr(f"`{pos_col}` div _a")))
    for k in range(ROUNDS):
        moved, by, size = ("_l", "_r", "_a") if k % 2 == 0 else ("_r", "_l", "_b")
        x = (x.withColumn("_x", (F.col(by) % PRIME * key(3 * k) + key(3 * k + 1)) % PRIME)
             .withColumn(moved, (F.col(moved) + (F.col("_x") * F.col("_x") + key(3 * k + 2)) % PRIME) % F.col(size)))
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    inside = lambda cell: cell["r"] * a + cell["l"] < n

    def one_round(cell, k):
        def shifted(c):
            v = ((c["r"] if k % 2 == 0 else c["l"]) % PRIME * key(3 * k) + key(3 * k + 1)) % PRIME
            by = lambda x: (x * x + key(3 * k + 2)) % PRIME
            return let(v, lambda x: F.struct(((c["l"] + by(x)) % a if k % 2 == 0 else c["l"]).alias("l"),
                                             (c["r"] if k % 2 == 0 else (c["r"] + by(x)) % b).alias("r")))
        return let(cell, shifted)

    def again(cell):
        for k in range(ROUNDS):
            cell = one_round(cell, k)
        return cell

    cell = F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"))
    walked = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), cell,
                         lambda c, _: F.when(inside(c), c).otherwise(again(c)), lambda c: c["r"] * a + c["l"])
    out = F.when(F.col("_r") * a + F.col("_l") < n, F.col("_r") * a + F.col("_l")).otherwise(walked)
    return x.withColumn(out_col, out).drop("_n", "_a", "_b", "_l", "_r", "_x")


def running_totals(df: DataFrame, group_cols: Sequence[str], order_col: str, value_col: str,
                   tie_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Running ``_rsum`` (of ``value_col``) and ``_rcnt`` (rows so far,
    current included) inside each group in (``order_col``, ``tie_cols``)
    order, plus the group's ``_gcnt``.  Nulls stand first; a null in a group
    column is a group of its own.

    A running window over a whole group would put the group (an epoch of
    training steps) into one task.  The rows are range-partitioned in order
    instead, which cuts them into blocks by their number, however sparse or
    equal the order values are.  Sums of each (block, group), a small table,
    give the offsets, and the window runs only inside a block.

    Sums of ordinary values are exact (DECIMAL(38,18)), so they do not
    depend on where the blocks fall or in which order partial sums meet.
    Values that this type does not hold are carried beside it: NaN and the
    two infinities as counts, larger values as a floating sum in order inside
    a block.  A sum with a NaN, or with both infinities, is NaN from there
    on, as in floating point; a null value adds nothing.  ``_rsum`` is DOUBLE."""
    groups = list(group_cols)
    v = F.col(value_col).cast("double")
    inf = float("inf")
    nan, up, down = F.isnan(v), v == F.lit(inf), v == F.lit(-inf)
    # The type holds 20 digits before the point: 10**8 values below LARGE in
    # one sum, more than a running group has steps.
    big = (F.abs(v) >= F.lit(LARGE)) & ~nan & ~up & ~down
    # Rare values as one struct, null for an ordinary value.
    rare = F.when(nan | up | down | big, F.struct(nan.alias("nan"), up.alias("up"), down.alias("down"),
                                                  F.when(big, v).alias("large")))
    x = (frozen_order(df, [*groups, order_col, *tie_cols], num_partitions)
         .withColumn("_v", F.when(~(nan | up | down | big), v).cast(EXACT)).withColumn("_rare", rare))
    sums = {"s": F.sum("_v"), "c": F.count(F.lit(1)), "nan": F.count_if("_rare.nan"), "up": F.count_if("_rare.up"),
            "down": F.count_if("_rare.down"), "large": F.sum("_rare.large")}
    blocks = x.groupBy("_pid", *groups).agg(*[c.alias("_b" + k) for k, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # Groups in full and in part: at most a row for each group and range.
    offs = blocks.select("_pid", *groups, *[F.sum("_b" + k).over(before).alias("_o" + k) for k in sums],
                         F.sum("_bc").over(Window.partitionBy(*groups)).alias("_gcnt"))
    w = Window.partitionBy("_pid", *groups).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda k, zero: F.coalesce(F.col("_o" + k), F.lit(zero)) + F.coalesce(sums[k].over(w), F.lit(zero))
    x = join_null_safe(x, offs, ["_pid", *groups])
    x = x.select("*", *[so_far(k, 0).alias("_t" + k) for k in ("c", "nan", "up", "down")],
                 (so_far("s", 0).cast("double") + so_far("large", 0.0)).alias("_finite"))
    total = (F.when((F.col("_tnan") > 0) | ((F.col("_tup") > 0) & (F.col("_tdown") > 0)), F.lit(float("nan")))
             .when(F.col("_tup") > 0, F.lit(inf)).when(F.col("_tdown") > 0, F.lit(-inf)).otherwise(F.col("_finite")))
    return x.select(*df.columns, total.alias("_rsum"), F.col("_tc").alias("_rcnt"), "_gcnt")
