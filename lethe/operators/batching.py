"""Training batches as tables.

Texts become word-level token ids (X18, standing in for a pretrained
tokenizer) in their rows, rows get a seeded shuffled position and a batch id
(E5), then ids are truncated, padded to the batch maximum and masked
(X14-X17).  All array work is row-local; the only shuffles are the vocabulary
count and those of E5.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.arrays import index_range, let
from lethe.functions.text import py_split
from lethe.operators.positions import join_null_safe, ordered_positions
from lethe.session import frozen, ship_package, short_batches

# Default maximum length, padding id and ignored label.
MAX_LENGTH = 384
PAD_ID = 0
IGNORE_INDEX = -100
# Llama special ids used by the label masking.
IMAGE_TOKEN_ID = 128256
END_OF_TURN_ID = 128009
HEADER_START_ID = 128006
HEADER_END_ID = 128007
SYSTEM_ROLE_ID = 9125
USER_ROLE_ID = 882
ASSISTANT_ROLE_ID = 78191
# Ids below this value are reserved (0 = padding, 1 = unknown).
FIRST_WORD_ID = 2
UNKNOWN_ID = 1
# Bytes of vocabulary that are broadcast for the token lookup, at most, and the
# longest word among them where the vocabulary is larger.
BROADCAST_BYTES = 32 << 20
BROADCAST_WORD = 64
# What a word takes beside its letters: its id and its offset.
ENTRY_BYTES = 12


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Word-level vocabulary of whole texts: ``token, count,
    token_id``; ids by descending count, then token (ids from 2).  The
    order is global, so positions come from range partitions (no
    single-partition window)."""
    counts = (texts.select(F.explode(py_split(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    ranked = ordered_positions(counts.withColumn("_neg", -F.col("count")), ["_neg", "token"], "_pos")
    return ranked.select("token", "count", (F.col("_pos") + FIRST_WORD_ID).cast("long").alias("token_id"))


class Lookup:
    """Words and their ids, as broadcast."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words, self.ids = words, ids

    def of(self, lists: pa.Array, otherwise: int) -> pa.Array:
        """The ids of lists of words: each distinct word of the batch is looked
        up once, the lists keep their shape."""
        flat = lists.flatten().dictionary_encode()
        known = self.ids.take(pc.index_in(flat.dictionary, value_set=self.words))
        return pa.ListArray.from_arrays(_offsets(lists), pc.fill_null(known, otherwise).take(flat.indices))


def _offsets(lists: pa.Array) -> pa.Array:
    """Where the lists begin and end in their flattened values (a null list is empty)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())


# Stands for a word that is not in the broadcast part of a vocabulary.
MISSED = -1


def _looked_up(words: Column, shared, otherwise: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def ids(w: pa.Array) -> pa.Array:
        return shared.value.of(w, otherwise)
    return ids(words)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _missed_words(words: pa.Array, ids: pa.Array) -> pa.Array:
    """The words whose id is MISSED, in order."""
    missed = pc.equal(ids.flatten(), MISSED)
    before = np.concatenate([[0], np.cumsum(missed.to_numpy(zero_copy_only=False))])
    at = pa.array(before[_offsets(ids).to_numpy()], pa.int32())
    return pa.ListArray.from_arrays(at, words.flatten().filter(missed))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _filled(ids: pa.Array, found: pa.Array) -> pa.Array:
    """``ids`` with the MISSED ones, in order, replaced by those of ``found``."""
    flat = ids.flatten()
    return pa.ListArray.from_arrays(_offsets(ids), pc.replace_with_mask(flat, pc.equal(flat, MISSED), found.flatten()))


def token_ids(texts: DataFrame, vocab: DataFrame, key_col: str | Sequence[str], text_col: str = "text",
              max_length: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``input_ids`` (array<bigint>) of each text, a row per text with
    its ``key_col``(s), which need be neither unique nor there: all its words,
    or with ``max_length`` the first ones (X14's cut); unknown words -> 1; a
    text without words, or null, has an empty array.

    Words are looked up in their rows, against the broadcast vocabulary.  Of a
    larger vocabulary only a head of so many frequent words of bounded length
    is broadcast (ids are frequency ranks); texts with a word beyond it are
    numbered, and those words alone go through a shuffle join."""
    spark = texts.sparkSession
    ship_package(spark)
    short_batches(spark)
    keys = [key_col] if isinstance(key_col, str) else list(key_col)
    kept = F.coalesce(py_split(text_col, max_length), F.array().cast("array<string>"))
    v = vocab.select("token", "token_id")
    whole = (v.agg(F.sum(F.octet_length("token") + ENTRY_BYTES)).first()[0] or 0) <= broadcast_bytes
    count = broadcast_bytes // (BROADCAST_WORD + ENTRY_BYTES)
    in_head = (F.col("token_id") < FIRST_WORD_ID + count) & (F.octet_length("token") <= BROADCAST_WORD)
    head = (v if whole else v.where(in_head)).toArrow().combine_chunks()
    column = lambda c: pa.concat_arrays(head.column(c).chunks) if head.num_rows else pa.array([], head.schema.field(c).type)
    shared = spark.sparkContext.broadcast(Lookup(column("token").cast(pa.string()), column("token_id")))
    x = texts.select(*keys, kept.alias("_words"))
    if whole:
        return x.select(*keys, _looked_up(F.col("_words"), shared, UNKNOWN_ID).alias("input_ids"))
    x = frozen(x.withColumn("_ids", _looked_up(F.col("_words"), shared, MISSED))
               .select(*keys, "_ids", _missed_words("_words", "_ids").alias("_missed"),
                       F.monotonically_increasing_id().alias("_row")), "tokens")
    each = x.select("_row", F.posexplode("_missed").alias("pos", "token")).join(v.where(~in_head), "token", "left")
    found = F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID).cast("long")).alias("i"))
    rows = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(found)), lambda s: s["i"]).alias("_found"))
    return (x.join(rows, "_row", "left")
            .select(*keys, _filled("_ids", F.coalesce("_found", F.array().cast("array<bigint>"))).alias("input_ids")))


def truncate(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    return F.slice(ids, 1, int(max_length))


def pad_to(ids: Column, length: Column, pad_id: int = PAD_ID) -> Column:
    """Right padding to ``length``."""
    fill = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), fill))


def attention_mask(n_tokens: Column, length: Column) -> Column:
    """1 per token, 0 per padding position."""
    return F.concat(F.array_repeat(F.lit(1), n_tokens),
                    F.array_repeat(F.lit(0), F.greatest(length - n_tokens, F.lit(0))))


def mask_labels(ids: Column, pad_id: int = PAD_ID, extra_ids: Sequence[int] = ()) -> Column:
    """labels = ids with padding (and ``extra_ids``, e.g. the llama
    image id) replaced by -100."""
    masked = [pad_id, *extra_ids]
    return F.transform(ids, lambda x: F.when(x.isin(masked), F.lit(IGNORE_INDEX).cast("long")).otherwise(x))


def mask_prompt_spans(ids: Column, pad_id: int = PAD_ID) -> Column:
    """X17 (llama dialogs): turns end at the end-of-turn id; a turn holding
    a system or user header is masked whole; then every assistant header
    is masked, except one starting in the last three positions (the
    benchmark's loop stops early there); finally padding and the image id.
    Ids after the last end-of-turn keep their labels.

    Row-local and linear in the sequence: the end-of-turn positions define
    the spans, each span is tested once and gives its labels as one piece.
    Intermediate arrays are bound once with ``let``."""
    at = F.get

    def prompt_header(v, p):
        return ((at(v, p) == HEADER_START_ID) & at(v, p + 1).isin(SYSTEM_ROLE_ID, USER_ROLE_ID)
                & (at(v, p + 2) == HEADER_END_ID))

    def with_ids(v):
        eots = F.filter(index_range(F.size(v)), lambda i: at(v, i) == END_OF_TURN_ID)
        return let(eots, lambda e: with_eots(v, e))

    def with_eots(v, eots):
        def piece(e, k):
            start = F.when(k == 0, F.lit(0)).otherwise(at(eots, k - 1) + 1)
            return let(start, lambda s: F.when(F.exists(
                F.when(e - 3 >= s, F.sequence(s, e - 3)).otherwise(F.array().cast("array<int>")),
                lambda p: prompt_header(v, p)), F.array_repeat(F.lit(IGNORE_INDEX).cast("long"), e - s + 1))
                .otherwise(F.slice(v, s + 1, e - s + 1)))
        done = F.when(F.size(eots) > 0, F.element_at(eots, F.lit(-1)) + 1).otherwise(F.lit(0))
        rest = let(done, lambda n: F.slice(v, n + 1, F.size(v) - n))
        return let(F.concat(F.flatten(F.transform(eots, piece)), rest), lambda lab: _mask_assistant(lab, pad_id))

    return let(ids.cast("array<bigint>"), with_ids)


def _mask_assistant(labels: Column, pad_id: int) -> Column:
    def body(lab):
        n = F.size(lab)
        ignored = F.lit(IGNORE_INDEX).cast("long")

        def hdr(p):
            return ((p >= 0) & (p <= n - 4) & (F.get(lab, p) == HEADER_START_ID)
                    & (F.get(lab, p + 1) == ASSISTANT_ROLE_ID) & (F.get(lab, p + 2) == HEADER_END_ID))

        return F.transform(lab, lambda x, i: F.when(
            hdr(i) | hdr(i - 1) | hdr(i - 2) | (x == pad_id) | (x == IMAGE_TOKEN_ID), ignored)
            .otherwise(x))
    return let(labels, body)


def padded_batches(rows: DataFrame, batch_cols: Sequence[str] = ("epoch", "batch_id"),
                   ids_col: str = "input_ids", max_length: int = MAX_LENGTH, pad_id: int = PAD_ID,
                   extra_mask_ids: Sequence[int] = ()) -> DataFrame:
    """Truncate, pad to the longest row of the batch, attention
    mask and labels.  The batch's length is the column ``batch_len`` where E5
    has made it (of lengths cut alike), else a per-batch aggregate joined back
    (a batch holds ``batch_size`` rows)."""
    x = rows.withColumn(ids_col, truncate(F.col(ids_col), max_length)).withColumn("n_tokens", F.size(ids_col))
    if "batch_len" not in rows.columns:
        m = x.groupBy(*batch_cols).agg(F.max("n_tokens").alias("batch_len"))
        x = join_null_safe(x, m, list(batch_cols))
    return (x.withColumn("labels", mask_labels(pad_to(F.col(ids_col), F.col("batch_len"), pad_id),
                                               pad_id, extra_mask_ids))
            .withColumn("attention_mask", attention_mask(F.col("n_tokens"), F.col("batch_len")))
            .withColumn(ids_col, pad_to(F.col(ids_col), F.col("batch_len"), pad_id)))


def preview(batches: DataFrame, n: int = 3, epoch: int | None = 0) -> DataFrame:
    """The first ``n`` rows of an epoch's first batch (a top-k by
    position); ``epoch=None`` for batches without epochs."""
    first = batches.where(F.col("batch_id") == 0)
    if epoch is not None:
        first = first.where(F.col("epoch") == int(epoch))
    return first.orderBy("pos").limit(int(n))


# ----------------------------------------------------------------------------
# Nested value -> token string

def json_to_token(col: Column, dtype: T.DataType, sort_keys: bool = True) -> Column:
    """``<s_k>v</s_k>`` per key (keys in descending order when
    sorting, else stored order), list items joined by ``<sep/>``, a struct
    holding only ``text_sequence`` is its value; scalars as Python's
    ``str`` (``True``); a NULL field counts as an absent key.  Built from the declared type, so the
    whole conversion is one Column expression."""
    if isinstance(dtype, T.StructType):
        names = [f.name for f in dtype.fields]
        if names == ["text_sequence"]:
            return json_to_token(col["text_sequence"], dtype["text_sequence"].dataType, sort_keys)
        order = sorted(names, reverse=True) if sort_keys else names
        # A NULL field is an absent key: it is left out, like a key the
        # JSON document does not have.
        parts = [F.when(col[k].isNull(), F.lit("")).otherwise(F.concat(
            F.lit(f"<s_{k}>"), json_to_token(col[k], dtype[k].dataType, sort_keys), F.lit(f"</s_{k}>")))
            for k in order]
        body = F.concat(*parts) if parts else F.lit("")
        return F.when(col.isNull(), F.lit("None")).otherwise(body)
    if isinstance(dtype, T.MapType):
        ent = F.map_entries(col)
        ent = F.array_sort(ent, lambda a, b: F.when(a["key"] > b["key"], -1)
                           .when(a["key"] < b["key"], 1).otherwise(0)) if sort_keys else ent
        return F.coalesce(F.array_join(F.transform(ent, lambda e: F.concat(
            F.lit("<s_"), e["key"], F.lit(">"), json_to_token(e["value"], dtype.valueType, sort_keys),
            F.lit("</s_"), e["key"], F.lit(">"))), ""), F.lit("None"))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(col, lambda v: json_to_token(v, dtype.elementType, sort_keys)),
                                       "<sep/>"), F.lit("None"))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.when(col, F.lit("True")).otherwise(F.lit("False")), F.lit("None"))
    return F.coalesce(col.cast("string"), F.lit("None"))
