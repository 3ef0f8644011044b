"""Evaluation inputs: question flattening, id-prefix selection, few-shot
exemplars and the labelled eval sets (P5, P6, J3, J7-J9, E6, E9).

Exemplars are at most a few rows (k <= 2 persons, one question per kind),
so their block is built by a tiny aggregate and attached by a broadcast
join on ``kind``; every other join is an equi join on the person id.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.functions import prompts as P
from lethe.functions.text import matches_glob
from lethe.operators.positions import seeded_hash
from lethe.operators.splits import DEFAULT_SEED, few_shot_k

# Classification kinds and the generation type that counts as image.
IMAGE_TEXTUAL = "Image_Textual"
PURE_TEXT = "Pure_Text"
# Eval modes that get a few-shot block.
FEW_SHOT_MODES = ("forget", "retain_shared", "test")
# The four evaluation sets of the report.
EVAL_SETS = ("forget", "test", "retain_shared", "celebrity")

_MCQ = "array<struct<Question:string,Options:map<string,string>,Correct_Answer:string>>"


def flatten_mcq(questions: DataFrame, id_col: str = "ID") -> DataFrame:
    """P5: both question arrays of each person as rows ``(id, kind,
    question_idx, Question, Options, Correct_Answer)``, index 1-based; a
    missing array counts as empty."""
    def part(arr: str, kind: str) -> DataFrame:
        return (questions.select(F.col(id_col).alias("id"),
                                 F.posexplode(F.coalesce(F.col(arr), F.array().cast(_MCQ))).alias("_i", "_q"))
                .select("id", F.lit(kind).alias("kind"), (F.col("_i") + 1).cast("int").alias("question_idx"),
                        "_q.Question", "_q.Options", "_q.Correct_Answer"))
    return part("Image_Textual_Questions", IMAGE_TEXTUAL).unionByName(part("Pure_Text_Questions", PURE_TEXT))


def flatten_generation(questions: DataFrame, id_col: str = "ID") -> DataFrame:
    """``(id, question_idx, Type, Question, Ground_Truth)``."""
    return (questions.select(F.col(id_col).alias("id"), F.posexplode("Generation_Questions").alias("_i", "_q"))
            .select("id", (F.col("_i") + 1).cast("int").alias("question_idx"),
                    "_q.Type", "_q.Question", "_q.Ground_Truth"))


def select_by_id_prefix(files: DataFrame, ids: DataFrame, name_col: str = "file_name",
                        id_col: str = "id", pattern: str = "*", delimiter: str = "") -> DataFrame:
    """Files whose name starts with an id of the list (plus
    ``delimiter``; empty keeps the benchmark's plain prefix test, where id
    ``10`` also selects ``100_...``) and matches ``pattern``; each file at
    most once.

    Equi form: for every distinct id length ``l`` the file's first ``l``
    characters are a join key, so this is a hash join, never a nested
    loop over files x ids.  The lengths themselves are a small aggregate
    joined on the file's own prefix lengths; nothing is collected."""
    keys = ids.select(F.concat(F.col(id_col), F.lit(delimiter)).alias("_key")).where(F.length("_key") > 0).distinct()
    keys = keys.withColumn("_len", F.length("_key"))
    f = files.where(matches_glob(name_col, pattern)) if pattern != "*" else files
    names = f.select(F.col(name_col).alias("_name")).where(F.length("_name") > 0).distinct()
    prefixes = names.withColumn("_len", F.explode(F.sequence(F.lit(1), F.length("_name"))))
    # No more lengths than characters in the longest file name.
    prefixes = prefixes.join(F.broadcast(keys.select("_len").distinct()), "_len", "left_semi")
    prefixes = prefixes.withColumn("_key", F.substring(F.col("_name"), F.lit(1), F.col("_len")))
    hit = prefixes.join(keys, ["_len", "_key"], "left_semi").select("_name").distinct()
    return f.join(hit, F.col(name_col) == F.col("_name"), "left_semi").dropDuplicates([name_col])


def sample_exemplar_ids(ids: DataFrame, model_id: str, id_col: str = "id",
                        seed: int = DEFAULT_SEED) -> DataFrame:
    """K persons (k by family) without replacement; ``rank`` gives
    their order.  A top-k, not a sort of the list."""
    k = few_shot_k(model_id)
    x = ids.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    top = x.withColumn("_h", seeded_hash(seed, "fewshot", F.col("id"))).orderBy("_h", "id").limit(k)
    return top.select("id", "_h")


def few_shot_lookup(flat_mcq: DataFrame, chosen: DataFrame) -> DataFrame:
    """First image-text and first text question of each chosen person
    (persons without a question file drop out).  ``chosen`` is a sample of
    k <= 2 ids, so it is broadcast."""
    return (flat_mcq.where(F.col("question_idx") == 1)
            .join(F.broadcast(chosen), "id")
            .select("id", "_h", "kind", "Question", "Options", "Correct_Answer"))


def few_shot_blocks(exemplars: DataFrame, model_id: str) -> DataFrame:
    """One block per kind, exemplars in sample order.  At most
    ``k * 2`` input rows."""
    item = F.when(F.col("kind") == IMAGE_TEXTUAL,
                  P.few_shot_item("Question", "Options", "Correct_Answer", model_id, True)) \
        .otherwise(P.few_shot_item("Question", "Options", "Correct_Answer", model_id, False))
    return (exemplars.groupBy("kind")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_h", "id", item.alias("t")))),
                                          lambda s: s["t"]), "").alias("few_shot")))


def classification_prompts(flat_mcq: DataFrame, mode: str, model_id: str,
                           exemplar_ids: DataFrame | None = None,
                           exemplar_questions: DataFrame | None = None) -> DataFrame:
    """J8 + J9 + X1/X5: the prompt of every question of an eval set.

    In the few-shot modes every question gets the exemplar block of its
    kind (llama drops it); in ``retain_shared`` the exemplar persons'
    questions are excluded.  ``exemplar_questions`` is the flat question
    table the exemplars come from (the retain folder in the benchmark)."""
    q = flat_mcq
    llama = P.family(model_id) == P.LLAMA
    if mode == "retain_shared" and exemplar_ids is not None:
        q = q.join(exemplar_ids.select("id"), "id", "left_anti")
    if mode in FEW_SHOT_MODES and exemplar_ids is not None and not llama:
        src = exemplar_questions if exemplar_questions is not None else flat_mcq
        blocks = few_shot_blocks(few_shot_lookup(src, exemplar_ids), model_id)
        # Bounded: one row per kind.
        q = q.join(F.broadcast(blocks), "kind", "left")
    else:
        q = q.withColumn("few_shot", F.lit(""))
    qwo = P.mcq_prompt("Question", "Options", llama=llama)
    prompt = F.when(F.col("kind") == IMAGE_TEXTUAL,
                    P.classification_prompt(qwo, F.col("few_shot"), model_id, True)) \
        .otherwise(P.classification_prompt(qwo, F.col("few_shot"), model_id, False))
    return q.withColumn("prompt", prompt).drop("few_shot")


def classification_prompts_by_set(flat_mcq: DataFrame, sets: DataFrame, model_id: str,
                                  exemplar_ids: DataFrame | None = None,
                                  exemplar_questions: DataFrame | None = None) -> DataFrame:
    """E9 + J8 + J9 + X1/X5 for several eval sets in one pass.

    ``sets`` maps a person to the eval sets (modes) it belongs to
    (``id, eval_set``); the question table is joined to it once.  Rows of
    ``retain_shared`` whose person is an exemplar are dropped, and the
    few-shot block of the row's kind is used only in the few-shot modes.
    The exemplar ids (k <= 2) and the blocks (one per kind) are bounded
    and broadcast."""
    return prompts_of_sets(flat_mcq.join(sets.select("id", "eval_set"), "id"), model_id, exemplar_ids,
                           exemplar_questions if exemplar_questions is not None else flat_mcq)


def prompts_of_sets(q: DataFrame, model_id: str, exemplar_ids: DataFrame | None,
                    exemplar_questions: DataFrame | None) -> DataFrame:
    """The same for questions that carry their ``eval_set``."""
    llama = P.family(model_id) == P.LLAMA
    few = F.lit("")
    if exemplar_ids is not None:
        ex = exemplar_ids.select(F.col("id").alias("_ex_id"))
        q = (q.join(F.broadcast(ex), F.col("id") == F.col("_ex_id"), "left")
             .where(~((F.col("eval_set") == "retain_shared") & F.col("_ex_id").isNotNull()))
             .drop("_ex_id"))
        if not llama:
            blocks = few_shot_blocks(few_shot_lookup(exemplar_questions, exemplar_ids), model_id)
            q = q.join(F.broadcast(blocks), "kind", "left")
            few = F.when(F.col("eval_set").isin(list(FEW_SHOT_MODES)), F.coalesce(F.col("few_shot"), F.lit("")))\
                .otherwise(F.lit(""))
    q = q.withColumn("_few", few)
    qwo = P.mcq_prompt("Question", "Options", llama=llama)
    prompt = F.when(F.col("kind") == IMAGE_TEXTUAL, P.classification_prompt(qwo, F.col("_few"), model_id, True)) \
        .otherwise(P.classification_prompt(qwo, F.col("_few"), model_id, False))
    return q.withColumn("prompt", prompt).drop("_few", "few_shot")


def generation_prompts(flat_gen: DataFrame, model_id: str) -> DataFrame:
    """X5 for generation questions; any type other than ``Image_Textual``
    is text."""
    img = F.col("Type") == IMAGE_TEXTUAL
    return flat_gen.withColumn(
        "prompt", F.when(img, P.generation_prompt("Question", model_id, True))
        .otherwise(P.generation_prompt("Question", model_id, False)))


def assemble_eval_sets(parts: dict[str, DataFrame], task: str) -> DataFrame:
    """The labelled union of the eval sets of one task (a row carries
    its set through prompts, scoring and the report)."""
    out = None
    for name, df in parts.items():
        x = df.withColumn("eval_set", F.lit(name)).withColumn("task", F.lit(task))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def keep_with_image(flat: DataFrame, manifest: DataFrame, by_set: bool = False) -> DataFrame:
    """Q4: classification skips a person without an image entirely (text
    questions too): a left semi join on the id.  With ``by_set`` both sides
    carry ``eval_set``: each set has an image folder of its own, and the
    same id in two folders is two persons."""
    if by_set:
        return flat.join(manifest.select("id", "eval_set"), ["id", "eval_set"], "left_semi")
    m = manifest.select(F.col("id").alias("_img"))
    return flat.join(m, F.col("id") == F.col("_img"), "left_semi")
