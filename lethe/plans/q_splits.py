"""Split, order and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.operators import splits as S
from lethe.operators.positions import ordered_positions
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import with_views
from lethe.plans.registry import domain, register
from lethe.plans.views import v_customer_ids, v_ids, v_qa, v_rows


@register("forget_split", with_views("v_customer_ids") + ", "
          + sb.split_cte("split", "v_customer_ids", [5, 10, 15]) + """
SELECT id, ratio, "set" FROM split""")
def q_forget_split(spark, d):
    """Exactly int(p/100*n) persons to forget per ratio."""
    return S.forget_retain_split(v_customer_ids(spark, d), ratios=[5, 10, 15])


@register("forget_split_nested", with_views("v_customer_ids") + """,
s AS (SELECT i.id, i.ratio,
             row_number() OVER (PARTITION BY i.ratio ORDER BY md5('42' || coalesce(':' || i.id, '')), i.id) AS rn,
             CAST(floor(CAST(i.ratio AS DOUBLE) / 100.0 * count(*) OVER (PARTITION BY i.ratio)) AS BIGINT) AS k
      FROM (SELECT id, CAST(unnest([5, 10, 15]) AS INTEGER) AS ratio FROM v_customer_ids) i)
SELECT id, ratio, CASE WHEN rn <= k THEN 'forget' ELSE 'retain' END AS "set" FROM s""")
def q_forget_split_nested(spark, d):
    """E3 with ``nested=True``: one order for all ratios."""
    return S.forget_retain_split(v_customer_ids(spark, d), ratios=[5, 10, 15], nested=True)


@register("holdout_split", with_views("v_customer_ids") + """,
s AS (SELECT id, row_number() OVER (ORDER BY md5('42:holdout' || coalesce(':' || id, '')), id) AS rn,
             CAST(floor(CAST(count(*) OVER () AS DOUBLE) * 0.3) AS BIGINT) AS k
      FROM v_customer_ids i)
SELECT id, CASE WHEN rn <= k THEN 'forget' ELSE 'retain' END AS "set" FROM s""")
def q_holdout_split(spark, d):
    """forget = int(n * 0.3), seeded."""
    return S.holdout_split(v_customer_ids(spark, d), forget_fraction=0.3)


@register("retain_complement", with_views("v_customer_ids") + ", "
          + sb.split_cte("split", "v_customer_ids", [10]) + """
SELECT DISTINCT id FROM v_customer_ids
WHERE id IS NULL OR id NOT IN (SELECT id FROM split WHERE "set" = 'forget' AND id IS NOT NULL)""")
def q_retain_complement(spark, d):
    """All ids minus the forget ids of the 10 % split."""
    ids = v_customer_ids(spark, d)
    forget = S.forget_retain_split(ids, ratios=[10]).where(F.col("set") == "forget")
    return S.retain_complement(ids, forget)


@register("sample_k_ids", with_views("v_ids") + """
SELECT id FROM (SELECT DISTINCT id FROM v_ids) t ORDER BY md5('42:fewshot:' || id), id LIMIT 2""")
def q_sample_k_ids(spark, d):
    """Two exemplar persons (llava), a seeded top-k."""
    return S.sample_few_shot_ids(v_ids(spark, d), "llava-hf/llava-1.5-7b-hf")


@register("ordered_scan", with_views("v_qa") + """
SELECT id, turn, CAST(row_number() OVER (ORDER BY id, turn) - 1 AS BIGINT) AS pos FROM v_qa""")
def q_ordered_scan(spark, d):
    """Global name order position without a single-partition window."""
    return ordered_positions(v_qa(spark, d).select("id", "turn"), ["id", "turn"], "pos")


@register("shuffled_batches", with_views("v_rows") + """
SELECT epoch, id, turn, pos, CAST(floor(pos / 4) AS BIGINT) AS batch_id, CAST(pos % 4 AS INTEGER) AS slot
FROM (SELECT q.epoch, q.id, q.turn,
             CAST(row_number() OVER (PARTITION BY q.epoch
                  ORDER BY md5('42:' || CAST(q.epoch AS VARCHAR) || coalesce(':' || q.id, '') || ':' || CAST(q.turn AS VARCHAR)),
                           q.id NULLS FIRST, q.turn) - 1 AS BIGINT) AS pos
      FROM (SELECT *, CAST(unnest([0, 1]) AS INTEGER) AS epoch FROM v_rows) q) t""")
def q_shuffled_batches(spark, d):
    """E5: seeded order per epoch, batches of 4 (the last one short); rows
    that share a key, or lack a part of it, have places of their own."""
    return (S.shuffled_batches(v_rows(spark, d), ["id", "turn"], batch_size=4, epochs=[0, 1])
            .select("epoch", "id", "turn", "pos", "batch_id", "slot"))


def _permuted_sql(source: str) -> str:
    """The permutation of column c of ``source(epoch, p, c)``, a round a level."""
    x = f"(SELECT s.epoch, p, n, a, b, ks, c % a AS l, c // a AS r FROM {source} s, grid, keys WHERE keys.epoch = s.epoch)"
    for k in range(6):
        by, size, out = ("r", "a", "l") if k % 2 == 0 else ("l", "b", "r")
        f = f"({by} % 2147483647 * ks[{3 * k + 1}] + ks[{3 * k + 2}]) % 2147483647"
        x = (f"(SELECT epoch, p, n, a, b, ks, {'r' if out == 'l' else 'l'}, "
             f"({out} + (f * f + ks[{3 * k + 3}]) % 2147483647) % {size} AS {out} FROM (SELECT *, {f} AS f FROM {x}))")
    return f"(SELECT epoch, p, n, r * a + l AS c FROM {x})"


@register("epoch_permutation", "WITH RECURSIVE " + with_views("v_rows").removeprefix("WITH ") + f""",
base AS (SELECT id, turn, row_number() OVER (ORDER BY id NULLS FIRST, turn) - 1 AS p FROM v_rows),
grid AS (SELECT n, a, (n + a - 1) // a AS b
         FROM (SELECT count(*) AS n, CAST(greatest(1, ceil(sqrt(CAST(count(*) AS DOUBLE)))) AS BIGINT) AS a FROM base)),
keys AS (SELECT epoch, list_transform(range(0, 18), lambda j:
                CAST('0x' || substr(md5('42:' || epoch || ':' || (j // 3)), CAST(7 * (j % 3) + 1 AS INTEGER), 7) AS BIGINT)) AS ks
         FROM (SELECT unnest(range(0, 10)) AS epoch)),
walk AS (SELECT epoch, p, n, c FROM {_permuted_sql("(SELECT epoch, p, p AS c FROM base, keys)")}
         UNION ALL
         SELECT epoch, p, n, c FROM {_permuted_sql("(SELECT epoch, p, c FROM walk WHERE c >= n)")})
SELECT CAST(epoch AS INTEGER) AS epoch, id, turn, c AS pos, c // 4 AS batch_id, CAST(c % 4 AS INTEGER) AS slot
FROM walk JOIN base ON walk.p = base.p WHERE c < n""")
def q_epoch_permutation(spark, d):
    """E5 for ten epochs: each epoch's order is a bijection on the rows'
    numbers, without a sort an epoch."""
    return (S.epoch_batches(v_rows(spark, d), ["id", "turn"], batch_size=4, epochs=range(10))
            .select("epoch", "id", "turn", "pos", "batch_id", "slot"))


@register("set_sizes", with_views("v_ids", "v_qa") + ", " + sb.split_cte("split", "v_ids", [5, 10, 15]) + """,
dom AS (SELECT * FROM (VALUES (5, 'forget'), (5, 'retain'), (10, 'forget'), (10, 'retain'),
                             (15, 'forget'), (15, 'retain')) a(ratio, "set")),
agg AS (SELECT s.ratio, s."set", count(DISTINCT s.id) AS n_profiles, count(q.id) AS n_rows
        FROM split s LEFT JOIN v_qa q ON q.id = s.id GROUP BY s.ratio, s."set")
SELECT d.ratio, d."set", coalesce(a.n_profiles, 0) AS n_profiles, coalesce(a.n_rows, 0) AS n_rows
FROM dom d LEFT JOIN agg a ON a.ratio = d.ratio AND a."set" = d."set" """)
def q_set_sizes(spark, d):
    """A5: profiles and flattened QA rows per (ratio, set); empty sets
    are listed with zeros."""
    split = S.forget_retain_split(v_ids(spark, d), ratios=[5, 10, 15])
    per_id = v_qa(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("_rows"))
    agg = (split.join(per_id, "id", "left")
           .groupBy("ratio", "set").agg(F.count(F.lit(1)).alias("n_profiles"),
                                        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("n_rows")))
    dom = domain(spark, ratio=[5, 10, 15], set=["forget", "retain"])
    return (dom.join(agg, ["ratio", "set"], "left").fillna(0, ["n_profiles", "n_rows"])
            .select("ratio", "set", "n_profiles", "n_rows"))


@register("split_roundtrip", with_views("v_customer_ids") + ", "
          + sb.split_cte("split", "v_customer_ids", [5, 10, 15]) + """
SELECT id, ratio, "set" FROM split""")
def q_split_roundtrip(spark, d):
    """S5 + S6: write ratio 5, then ratios 5, 10 and 15 under a fresh folder
    (the saved ratio 5 stays), and read each back."""
    from lethe.session import scratch
    from lethe.sources import load_split, write_split
    root = scratch(spark, "splits")
    ids = v_customer_ids(spark, d)
    write_split(S.forget_retain_split(ids, ratios=[5]), root)
    write_split(S.forget_retain_split(ids, ratios=[5, 10, 15]), root)
    out = None
    for ratio in (5, 10, 15):
        for name, part in zip(("forget", "retain"), load_split(spark, root, ratio)):
            part = part.select("id", F.lit(ratio).alias("ratio"), F.lit(name).alias("set"))
            out = part if out is None else out.unionByName(part)
    return out
