"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most ``d`` bits, cut into
``d // 2 + 1`` segments (two of 32 bits for d = 3), have a segment that differs in at most one bit.
Each segment is indexed under its one-wildcard variants: the segment with
one bit deleted, for each bit.  Equal variants meet in an equality join by
a shuffle, and the whole fingerprints are verified there.

Only distinct fingerprints are indexed, so exact copies cost nothing.  A
task reads its variants in order and turns the verified links that it sees
into a spanning forest before it writes them, so a group of near copies
writes fewer links than it has members, not all its pairs.  A variant that
is shared by more than ``WIDE`` fingerprints is not compared in a task: its
members are indexed again under variants of the bits they need not share
(half of those left, one wildcard), and so on until the bits left bound the
group.  That split is exact: the remaining bits differ by at most ``d`` too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import (BLANK_BYTE, LOWER_BYTE, NULL_ID, fresh, joined_words, mix, short_batches, staged,
                              text_chunks, word_spans)
from lethe.llm.components import connected

SEED = 42
# Members of one variant compared in one task; wider variants are split.
WIDE = 4096
# Rows of the sorted variants that a task holds at once.
HELD = 1 << 19


def fingerprint_texts(column, shingle: int) -> np.ndarray:
    """SimHash of each text of an Arrow string array (uint64)."""
    out = np.zeros(len(column), np.uint64)
    digest = xxhash.xxh64_intdigest
    for first, raw, offs in text_chunks(column):
        data = LOWER_BYTE[raw]
        starts, ends, text = word_spans(data, offs, ~BLANK_BYTE)
        if not len(starts):
            continue
        joined, a, b = joined_words(data, starts, ends)
        of, n = np.unique(text, return_counts=True)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        take = np.maximum(n - shingle + 1, 1)
        firsts = np.repeat(begin - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
        lasts = np.minimum(firsts + shingle - 1, np.repeat(begin + n - 1, take))
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a[firsts].tolist(), b[lasts].tolist())),
                        np.uint64, len(firsts))
        ends_at = np.cumsum(take)
        i = 0
        while i < len(take):  # some texts at a time: 64 counters for each shingle
            j = max(i + 1, int(np.searchsorted(ends_at, (ends_at[i - 1] if i else 0) + (1 << 16), "right")))
            lo, hi = ends_at[i] - take[i], ends_at[j - 1]
            ones = np.zeros((j - i, 64), np.int64)
            for s in range(lo, hi, 1 << 16):
                e = min(hi, s + (1 << 16))
                bits = np.unpackbits(h[s:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k = np.arange(int(np.searchsorted(ends_at, s, "right")), int(np.searchsorted(ends_at, e - 1, "right")) + 1)
                at = np.maximum(ends_at[k] - take[k], s) - s
                ones[k - i] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
            packed = np.packbits(2 * ones > take[i:j, None], axis=1, bitorder="little")
            out[first + of[i:j]] = np.ascontiguousarray(packed).view(np.uint64).ravel()
            i = j
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tid, fp): one row per row; tid is the text's 64-bit hash, fp
    the fingerprint, both as longs.

    A text of fewer words than a shingle is one shingle; a text without
    words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_texts(b.column(2), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "tid", "fp"])

    short_batches(docs.sparkSession)
    return (docs.select(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"]), docs["text"])
            .mapInArrow(run, "doc_id bigint, tid bigint, fp bigint"))


class Forest:
    """Union of verified links between fingerprints; gives a spanning forest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.fromiter(self.up.keys(), np.int64, len(self.up))
        return a, np.fromiter(self.up.values(), np.int64, len(self.up))


def _link_runs(key: np.ndarray, fp: np.ndarray, most: int, forest: Forest) -> None:
    """Links of fingerprints at ``most`` bits or fewer inside each run of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    u = fp.view(np.uint64)
    small = np.repeat((size > 1) & (size <= 8), size)
    run = np.repeat(np.arange(len(size)), size)
    for step in range(1, 8):
        i = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if len(key) > step else np.zeros(0, int)
        if not len(i):
            break
        near = np.bitwise_count(u[i] ^ u[i + step]) <= most
        i = i[near]
        pairs = np.unique(np.stack([fp[i], fp[i + step]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        forest.link(pairs[:, 0], pairs[:, 1])
    for k in np.flatnonzero(size > 8):
        left = u[edge[k]:edge[k + 1]]
        # Breadth first over the members not reached yet.
        queue: list[np.uint64] = []
        while len(left):
            if not queue:
                queue, left = [left[0]], left[1:]
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                hit = left[near]
                forest.link(np.full(len(hit), x, np.uint64).view(np.int64), hit.view(np.int64))
                queue.extend(hit)
                left = left[~near]


def _variants(fp: np.ndarray, key: np.ndarray | None, parts: list[tuple[int, int]]):
    """(key, fp, part) rows: for each segment (low bit, bits) and each deleted
    bit, a 64-bit key of what is left of the segment, inside the key before."""
    u = fp.view(np.uint64)
    keys, fps, part = [], [], []
    for p, (low, bits) in enumerate(parts):
        segment = (u >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        for w in range(bits):
            k = mix((segment & ~np.uint64(1 << w)) + np.uint64((p * 64 + w + 1) << 40))
            keys.append(k if key is None else mix(k ^ key.view(np.uint64)))
            fps.append(fp)
            part.append(np.full(len(fp), p, np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(fps), np.concatenate(part)


def _segments(low: int, bits: int, most: int) -> list[tuple[int, int]]:
    """Segments of which one differs in at most one bit if all differ in ``most`` at most."""
    n = most // 2 + 1
    cut = [low + bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:]) if b > a]


def near_links(distinct: DataFrame, most: int, wide: int = WIDE) -> DataFrame:
    """Links (a, b) that join the same fingerprints into components as all
    pairs of ``distinct(fp)`` at ``most`` bits or fewer."""
    spark = distinct.sparkSession
    free = [[(0, 64)]]  # by the way that rows came here: the bits that need not be equal
    index = distinct.select("fp", F.lit(0).alias("way"), F.lit(None).cast("bigint").alias("key"))
    links = None
    while True:
        ways = [_segments(*regions[0], most) for regions in free]

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # way numbers the segment lists; a row's next way is the list position of its segment.
            base = np.cumsum([0, *[len(x) for x in ways]])
            for batch in batches:
                for b in (batch.slice(i, 1 << 12) for i in range(0, batch.num_rows, 1 << 12)):
                    fp, way = b.column(0).to_numpy(), b.column(1).to_numpy()
                    for w in np.unique(way):
                        on = way == w
                        key = None if b.column(2).null_count else b.column(2).to_numpy(zero_copy_only=False)[on]
                        k, f, p = _variants(fp[on], key, ways[w])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(f), pa.array((p + base[w]).astype(np.int32)), pa.array(k)], ["fp", "way", "key"])

        free = [sorted([x for x in whole if x != used] + regions[1:], key=lambda x: -x[1])
                for whole, regions in zip(ways, free) for used in whole]
        final = all(sum(bits for _, bits in x) <= 8 for x in free)
        variants = index.mapInArrow(expand, "fp bigint, way int, key bigint")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, held, count = Forest(), [], 0
            passed: list[int] = []  # the wide variant of the rows before

            def settle(last: bool) -> tuple[np.ndarray, ...]:
                key, fp, way = (np.concatenate(x) for x in zip(*held))
                cut = len(key) if last else int(np.searchsorted(key, key[-1]))
                if not (last or final) and len(key) - cut > wide:
                    cut = len(key)  # a wide variant is passed on as it comes
                k, f, w = key[:cut], fp[:cut], way[:cut]
                edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]])) if cut else np.zeros(1, int)
                size = np.repeat(np.diff(edge), np.diff(edge))
                broad = ((size > wide) | np.isin(k, passed)) & (not final)
                if cut and broad[-1]:
                    passed[:] = [k[-1]]
                if not broad.all():
                    _link_runs(k[~broad], f[~broad], most, forest)
                held[:] = [(key[cut:], fp[cut:], way[cut:])] if cut < len(key) else []
                return f[broad], w[broad], k[broad]

            def rows(f, w, k):
                return pa.RecordBatch.from_arrays(
                    [pa.array(f), pa.array(np.zeros(len(f), np.int64)), pa.array(w.astype(np.int32)), pa.array(k)],
                    ["a", "b", "way", "key"])

            for b in batches:
                held.append((b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(1).to_numpy()))
                count += b.num_rows
                if count >= HELD:
                    out = settle(False)
                    count = sum(len(x[0]) for x in held)
                    if len(out[0]):
                        yield rows(*out)
            if held:
                out = settle(True)
                if len(out[0]):
                    yield rows(*out)
            a, b = forest.links()
            for i in range(0, len(a), 1 << 16):
                n = len(a[i:i + (1 << 16)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[i:i + n]), pa.array(b[i:i + n]), pa.array(np.full(n, -1, np.int32)),
                     pa.array(np.zeros(n, np.int64))], ["a", "b", "way", "key"])

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = staged(variants.repartition(n, "key").sortWithinPartitions("key")
                       .mapInArrow(compare, "a bigint, b bigint, way int, key bigint"))
        these = found.where("way < 0").select("a", "b")
        links = these if links is None else links.union(these)
        if final or found.where("way >= 0").isEmpty():
            return links
        # The members of wide variants, indexed again by the bits that they need not share.
        index = found.where("way >= 0").select(F.col("a").alias("fp"), "way", "key")


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    Texts link when their fingerprints differ in ``bits`` bits or fewer
    (equal ones too); component_id is the smallest doc_id reachable, the
    row's own included.  A null doc_id counts only where a component has no
    other: then component_id is null.  Repeated rows repeat their result."""
    return _components(docs, shingle, bits).select("doc_id", "fp", "component_id")


def _components(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(doc_id, tid, fp, root, component_id) of each row; root is the component's smallest fingerprint."""
    marked = staged(fingerprints(docs, shingle))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    # Dealt out by count: each fingerprint becomes many variants, which its own few bytes don't tell.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = near_links(first.select("fp").repartition(n, "fp"), bits)
    root = connected(links).select(F.col("node").alias("fp"), "root")
    # The smallest id of each component; a fingerprint without links is its own root.
    rooted = staged(first.join(root, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(component, "fp").select("doc_id", "tid", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``docs``, same columns, with one row of each component: the one of the
    smallest doc_id (null only where there is no other; then, as for texts
    that share a doc_id, that of the smallest hash), and of rows equal in
    doc_id and text any one."""
    found = _components(docs, shingle, bits)
    own_id, own_tid = fresh(docs, "__id", "__tid")
    # One (id, tid) of each component.
    keeper = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
              .groupBy("root").agg(F.min("component_id").alias("least"), F.min("tid").alias(own_tid))
              .select(F.coalesce("least", F.lit(NULL_ID)).alias(own_id), own_tid))
    id_, tid = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)), F.xxhash64(docs["text"])
    kept = docs.join(keeper, (id_ == keeper[own_id]) & (tid == keeper[own_tid]))
    return kept.dropDuplicates([own_id, own_tid]).select(*docs.columns)
