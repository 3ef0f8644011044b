"""Forget/retain splits, samples and batch order.

Sizes are exact (``int(p/100*n)`` like a shuffled list cut at an index),
never ``randomSplit``/``sample``.  Order is ``md5(seed:...:id)``: stable
under task retry and reproducible in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lethe.operators.positions import (BUCKET_DIGITS, bucket_offsets, hash_positions, ordered_positions, permutation_keys,
                                       permute, seeded_hash)
from lethe.session import frozen

# Forget percentages of the benchmark and its default seed.
DEFAULT_RATIOS = (5, 10, 15)
DEFAULT_SEED = 42
# Few-shot exemplars per model family (prefix of the model id).
FEW_SHOT_K = {"HuggingFaceM4": 1, "llava": 2, "meta-llama": 1}


def _exact_cut(x: DataFrame, hash_col: str, id_col: str, group_cols: Sequence[str],
               size_of_n, prefix: int | None) -> DataFrame:
    """Label the first ``size_of_n(n)`` rows of each group (hash order)
    'forget', the rest 'retain'.  Rows of one id are counted first, so a
    repeated id is one row; only the ids of the bucket holding the cut are
    ranked, and only the id that the cut divides gives rows to both sets."""
    b = "_bucket"
    # Rows that agree in all of these are alike: their number is enough.
    keyed = x.groupBy(*group_cols, hash_col, id_col).agg(F.count(F.lit(1)).alias("_times"))
    keyed = keyed.withColumn(b, F.substring(F.col(hash_col), 1, prefix))
    offs = (bucket_offsets(keyed, b, group_cols, F.col("_times"))
            .withColumn("k", size_of_n(F.col("n")))
            .select(*group_cols, b, "off", "cnt", "k"))
    j = keyed.join(offs, [*group_cols, b])
    whole = (F.col("off") + F.col("cnt") <= F.col("k")) | (F.col("off") >= F.col("k"))
    n_forget = F.when(F.col("off") < F.col("k"), F.col("_times")).otherwise(F.lit(0))
    decided = j.where(whole).withColumn("_forget", n_forget)
    w = (Window.partitionBy(*group_cols, b).orderBy(hash_col, id_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("off") + F.coalesce(F.sum("_times").over(w), F.lit(0))
    cut = (j.where(~whole)
           .withColumn("_forget", F.greatest(F.lit(0), F.least(F.col("_times"), F.col("k") - before))))
    # Each id's rows again, as (set, how many).
    parts = F.array(F.struct(F.lit("forget").alias("set"), F.col("_forget").cast("int").alias("n")),
                    F.struct(F.lit("retain").alias("set"), (F.col("_times") - F.col("_forget")).cast("int").alias("n")))
    rows = decided.unionByName(cut).select(*group_cols, id_col, F.inline(parts)).where(F.col("n") > 0)
    # In steps, so that an id of very many rows makes no very long array.
    step = F.lit(1 << 16)
    return (rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {1 << 16}").cast("int"))))
            .withColumn("_again", F.explode(F.array_repeat(F.lit(True), F.least(step, F.col("n") - F.col("_k") * step))))
            .drop("_again", "_k", "n"))


def forget_size(ratio: Column, n: Column) -> Column:
    """``int(p / 100 * n)`` evaluated in binary floating point like Python."""
    return F.floor(ratio.cast("double") / F.lit(100.0) * n.cast("double")).cast("long")


def forget_retain_split(ids: DataFrame, id_col: str = "id",
                        ratios: Sequence[int] = DEFAULT_RATIOS, seed: int = DEFAULT_SEED,
                        nested: bool = False, prefix: int = BUCKET_DIGITS) -> DataFrame:
    """Per ratio p, exactly int(p/100*n) profiles to forget, the rest retain.

    Every row is a profile: rows that share an id count each, and null ids
    too (as in a cut of the list of profiles; ``curate.profile_id`` gives
    profiles without an id one of their own).  With ``nested`` the order
    does not depend on p, so a smaller forget set is inside every larger
    one.  Returns ``(id, ratio, set)``, a row per row of ``ids`` and ratio.
    """
    x = (ids.select(F.col(id_col).cast("string").alias("id"))
         .withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios]))))
    # A null id is hashed like the empty one.
    h = seeded_hash(seed, F.col("id")) if nested else seeded_hash(seed, F.col("ratio"), F.col("id"))
    x = x.withColumn("_h", h)
    out = _exact_cut(x, "_h", "id", ["ratio"], lambda n: forget_size(F.col("ratio"), n), prefix)
    return out.select("id", "ratio", "set")


def holdout_split(ids: DataFrame, id_col: str = "id", forget_fraction: float = 0.3,
                  seed: int = DEFAULT_SEED, prefix: int = BUCKET_DIGITS) -> DataFrame:
    """Seeded split with forget = int(n * f); every row counts, as in E3.
    Returns ``(id, set)``."""
    x = (ids.select(F.col(id_col).cast("string").alias("id"))
         .withColumn("_h", seeded_hash(seed, "holdout", F.col("id"))))
    size = lambda n: F.floor(n.cast("double") * F.lit(float(forget_fraction))).cast("long")
    return _exact_cut(x, "_h", "id", [], size, prefix).select("id", "set")


def retain_complement(all_ids: DataFrame, forget_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """retain = all - forget (ids unique), as an anti join."""
    a = all_ids.select(F.col(id_col).alias("id")).distinct()
    return a.join(forget_ids.select(F.col(id_col).alias("id")), "id", "left_anti")


def few_shot_k(model_id: str) -> int:
    for prefix, k in FEW_SHOT_K.items():
        if model_id.startswith(prefix):
            return k
    raise ValueError(f"unsupported model family: {model_id}")


def sample_ids(ids: DataFrame, k: int, id_col: str = "id", seed: int = DEFAULT_SEED) -> DataFrame:
    """K distinct ids without replacement, seeded (top-k, no full sort)."""
    x = ids.select(F.col(id_col).alias("id")).distinct()
    return (x.withColumn("_h", seeded_hash(seed, "fewshot", F.col("id")))
            .orderBy("_h", "id").limit(k).drop("_h"))


def sample_few_shot_ids(ids: DataFrame, model_id: str, id_col: str = "id",
                        seed: int = DEFAULT_SEED) -> DataFrame:
    return sample_ids(ids, few_shot_k(model_id), id_col, seed)


def _batch_columns(placed: DataFrame, batch_size: int, size_col: str | None) -> DataFrame:
    """``batch_id = pos div batch_size`` (last batch short), ``slot`` inside
    the batch, and with ``size_col`` its maximum in the batch, ``batch_len``."""
    bs = int(batch_size)
    placed = (placed.withColumn("batch_id", F.expr(f"pos div {bs}")).withColumn("slot", (F.col("pos") % bs).cast("int")))
    if size_col is None:
        return placed
    # A batch holds batch_size rows of keys.
    return placed.withColumn("batch_len", F.max(size_col).over(Window.partitionBy("epoch", "batch_id"))).drop(size_col)


def shuffled_batches(rows: DataFrame, key_cols: Sequence[str], batch_size: int = 4,
                     epochs: Sequence[int] = (0,), seed: int = DEFAULT_SEED, prefix: int = BUCKET_DIGITS,
                     tie_cols: Sequence[str] = (), size_col: str | None = None) -> DataFrame:
    """E5: per epoch a seeded random order of all rows; ``pos``, ``batch_id``
    and ``slot``, and ``batch_len`` where ``size_col`` is given.

    The order is by a hash of ``key_cols``.  Every row has a place of its own:
    rows that share a key (or have none) follow one another by ``tie_cols``,
    rows equal in both in no set order.  Only the keys are ordered; the rest
    of a row is numbered, written once and joins its places by that number."""
    keys = list(dict.fromkeys([*key_cols, *tie_cols]))
    payload = [c for c in rows.columns if c not in key_cols]
    if payload:
        rows = frozen(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        keys.append("_row")
    x = rows.select(*keys, *([F.col(size_col).alias("_size")] if size_col else []))
    x = x.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    x = x.withColumn("_h", seeded_hash(seed, F.col("epoch"), *[F.col(c) for c in key_cols]))
    placed = _batch_columns(hash_positions(x, "_h", keys, ["epoch"], prefix), batch_size, "_size" if size_col else None)
    new = ["epoch", "pos", "batch_id", "slot", *(["batch_len"] if size_col else [])]
    if not payload:
        return placed.select(*key_cols, *new)
    return rows.join(placed.select("_row", *new), "_row").drop("_row")


def epoch_batches(rows: DataFrame, order_cols: Sequence[str], batch_size: int = 4, epochs: Sequence[int] = (0,),
                  seed: int = DEFAULT_SEED, size_col: str | None = None) -> DataFrame:
    """E5 for many epochs: as ``shuffled_batches``, but the order of an epoch
    is a permutation of the rows' numbers in ``order_cols`` order, so no epoch
    sorts anything.  Rows may share keys or have none: each has a number of
    its own (rows equal in all order columns in no set order)."""
    base = ordered_positions(rows, order_cols, "_row", total_col="_total")
    plans = F.array(*[F.struct(F.lit(int(e)).alias("epoch"),
                               F.array(*[F.lit(k).cast("long") for k in permutation_keys(seed, int(e))]).alias("_keys"))
                      for e in epochs])

    def placed(x):
        x = x.withColumn("_plan", F.explode(plans)).select("*", "_plan.epoch", "_plan._keys").drop("_plan")
        return _batch_columns(permute(x, "_row", "_total", "_keys", "pos").drop("_keys", "_total"), batch_size, size_col)

    if size_col is None:
        return placed(base).drop("_row")
    # The batches' maxima meet as keys and numbers only.
    return base.drop("_total").join(placed(base.select("_row", "_total", size_col)), "_row").drop("_row")
