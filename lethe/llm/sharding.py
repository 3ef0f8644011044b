"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a key belongs to the shard of the
next point clockwise.  No shard takes more than its bound: keys that overflow
a full shard continue clockwise to the next shard with room.  With the bound
at the mean (rounded up for the first shards, down for the rest) the shards'
counts are at most one apart; a looser bound moves fewer keys when a shard
is added.

The ring is cut into ``CELLS`` equal cells.  Spark counts the keys of each
cell; who takes how many keys of which cell follows from these counts alone
(a walk over the cells on the driver, whose size is fixed by the number of
cells and shards).  Rows equal in all columns are counted first; the distinct
ones are ranked inside a part of their cell, with the counts of the parts
before it as offset, and their ranks are cut by the cell's quotas.  So a key,
or one repeated row, of a third of all rows is spread over tasks, and no row
passes the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lethe.llm.common import staged

# A power of two; the top bits of a hash are its cell.
CELLS = 1 << 14
VIRTUAL_NODES = 64
# Parts of a cell that are ranked apart, as a power of two.
PART_BITS = 6
# Equal rows that one record stands for, at most, when they become rows again.
STEP = 1 << 12


def _cell(h):
    """The ring cell of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - (CELLS.bit_length() - 1)).cast("int")


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[int]:
    """The points of the ring clockwise, as (cell, shard)."""
    points = (spark.range(shards * virtual_nodes)
              .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("node"))
              .withColumn("h", F.xxhash64(F.lit("node"), "shard", "node"))
              .select(_cell(F.col("h")).alias("cell"), "h", "shard"))
    # Unsigned order inside a cell: the signed order is the same there.
    return [(r.cell, r.shard) for r in points.orderBy("cell", "h", "shard").collect()]


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most keys of each shard.  Without slack: floor or ceiling of the mean."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def quotas(points: list[tuple[int, int]], counts: dict[int, int], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): who takes which keys
    of a cell.  Cells are walked clockwise; each row below either uses up a
    cell or fills a shard, so there are at most cells + shards of them."""
    taken = [0] * len(most)
    n = len(points)
    nxt = list(range(n + 1))  # the next point clockwise whose shard may have room

    def open_point(p: int) -> int:
        turns = 0
        while True:
            path = []
            while nxt[p] != p:
                path.append(p)
                p = nxt[p]
            for q in path:
                nxt[q] = p
            if p == n:  # past the last point: once around
                turns += 1
                if turns > 1:
                    raise ValueError("the bounds hold fewer keys than there are")
                p = 0
                continue
            if taken[points[p][1]] < most[points[p][1]]:
                return p
            nxt[p] = p + 1

    out, p = [], 0
    for cell in sorted(counts):
        while p < n and points[p][0] < cell:
            p += 1
        rank, at = 0, p
        while rank < counts[cell]:
            at = open_point(at if at < n else 0)
            shard = points[at][1]
            take = min(counts[cell] - rank, most[shard] - taken[shard])
            out.append((cell, rank, rank + take, shard, taken[shard]))
            taken[shard] += take
            rank += take
    return out


def assign_shards(docs: DataFrame, shards: int = 40, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row per row.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32: of the
    UTF-8 text (null as empty).  The key on the ring is the doc_id, or size
    and crc where it is null; rows inside a cell are ordered by a hash of
    doc_id, size and crc, then by these, so rows equal in all of them (ties,
    repeated rows) are interchangeable.  An empty table gives no rows; other
    columns are not read, whatever their names; a text of any length counts
    by its bytes.  slot numbers a
    shard's rows from 0 without gaps.  law is ``rows`` without slack: shard
    counts are at most one apart.  That law bounds every shard by the number
    of rows, so where a row goes depends on the others too, and grown_shard
    (of law ``key``) is null."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                        (F.octet_length(text) + 16).cast("bigint").alias("size"),
                        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"))
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("key"), "doc_id")).otherwise(
        F.xxhash64(F.lit("null"), "size", "text_crc32"))
    # Rows equal in all columns are counted; a part of a cell holds a share of
    # its distinct rows, also where one key has very many.
    alike = keyed.withColumn("cell", _cell(h)).groupBy("doc_id", "size", "text_crc32", "cell").agg(
        F.count(F.lit(1)).alias("times"))
    alike = alike.withColumn("o", F.xxhash64(F.lit("order"), "doc_id", "size", "text_crc32"))
    alike = staged(alike.withColumn("part", F.shiftrightunsigned("o", 64 - PART_BITS)))
    parts = staged(alike.groupBy("cell", "part").agg(F.sum("times").alias("times")))
    counts = {r[0]: r[1] for r in parts.groupBy("cell").agg(F.sum("times")).collect()}
    takes = quotas(ring(spark, shards, virtual_nodes), counts, bounds(sum(counts.values()), shards, slack))
    schema = "array<struct<c: int, a: bigint, b: bigint, shard: int, s: bigint>>"
    names = ("c", "a", "b", "shard", "s")
    table = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps([dict(zip(names, t)) for t in takes])), schema)))
    def before(window):
        return F.coalesce(F.sum("times").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = parts.select(F.col("cell").alias("in_cell"), F.col("part").alias("in_part"),
                         before(Window.partitionBy("cell").orderBy("part")).alias("ahead"))
    placed = alike.join(ahead, (F.col("cell") == F.col("in_cell")) & (F.col("part") == F.col("in_part")))
    rank = F.col("ahead") + before(Window.partitionBy("cell", "part").orderBy("o", "doc_id", "size", "text_crc32"))
    placed = placed.withColumn("rank", rank)
    # At most CELLS + shards rows of five numbers; a group's ranks are cut where the quotas are.
    cut = placed.join(F.broadcast(table), (F.col("cell") == F.col("c")) & (F.col("rank") < F.col("b"))
                      & (F.col("rank") + F.col("times") > F.col("a")))
    first, end = F.greatest("rank", "a"), F.least(F.col("rank") + F.col("times"), F.col("b"))
    cut = cut.select("doc_id", "size", "text_crc32", "shard", (F.col("s") + first - F.col("a")).alias("slot"),
                     (end - first).alias("n"))
    # Equal rows again, in steps that are dealt out before they become rows.
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {STEP}")))
    cut = cut.withColumn("k", steps).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "slot", "k")
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(STEP), F.col("n") - F.col("k") * STEP) - 1))
    return (cut.withColumn("i", again)
            .select("doc_id", "size", "text_crc32", F.lit("rows" if not slack else "bound").alias("law"), "shard",
                    (F.col("slot") + F.col("k") * STEP + F.col("i")).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
