"""End-to-end jobs: the benchmark's three entry points as compositions of
the operators (curate + split, training batches, evaluation).

Each job reads folders, runs Spark plans and writes partitioned outputs;
nothing is collected except the counts it returns.  Model training and
generation stay outside: ``eval_prompts`` writes the prompts the model
answers, and ``score_predictions`` reads its answers back as a table
(``lethe.schemas.PREDICTIONS`` / generation predictions).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe import sources as S
from lethe.functions.prompts import train_prompt
from lethe.functions.text import extract_response
from lethe.operators import batching as B
from lethe.operators import curate as C
from lethe.operators import eval_sets as ES
from lethe.operators import report as RP
from lethe.operators.scoring import score_mcq, text_scores
from lethe.operators.splits import DEFAULT_RATIOS, DEFAULT_SEED, epoch_batches, forget_retain_split


def curate_and_split(spark: SparkSession, qa_dir: str, person_dir: str, image_dir: str, out_dir: str,
                     ratios: Sequence[int] = DEFAULT_RATIOS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Upsert each person's last QA into the training profiles (J4, by file
    name), write the curated profiles (S7), split persons with an image (J1)
    into forget/retain per ratio (E3; a profile without an ``ID`` goes by
    its file name), write the split where it is not there yet (S5) and the
    id lists of the saved split (S4).  Returns the set sizes (A5): profiles
    and QA rows per set."""
    targets = C.with_person(S.read_training_profiles(spark, qa_dir), "_qa")
    persons = C.with_person(S.read_persons(spark, person_dir))
    curated = C.upsert_additional_qa(targets, persons, "person", "person")
    # The written profiles have many persons a file: the file's person is kept as the ID where that is missing.
    curated = curated.withColumn("ID", F.coalesce("ID", "person", C.file_stem("file_name"))).drop("person", "file_name")
    S.write_profiles(curated, os.path.join(out_dir, "profiles"))
    curated = S.read_training_profiles(spark, os.path.join(out_dir, "profiles"), lines=True).drop("file_name")
    with_img = C.with_image_file(curated, S.image_listing(spark, image_dir))
    split = forget_retain_split(with_img.select(F.col("ID").alias("id")), ratios=ratios, seed=seed)
    S.write_split(split, os.path.join(out_dir, "split"))
    saved = S.read_split(spark, os.path.join(out_dir, "split"))
    S.write_id_lists(saved, os.path.join(out_dir, "id_lists"))
    rows = (C.flatten_qa(with_img, "loose").groupBy(F.col("ID").alias("id")).agg(F.count(F.lit(1)).alias("_n")))
    # Profiles that share an id count each, their rows once a set.
    return (saved.groupBy("ratio", "set", "id").agg(F.count(F.lit(1)).alias("_p")).join(rows, "id", "left")
            .groupBy("ratio", "set").agg(F.sum("_p").alias("n_profiles"),
                                         F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows")))


def training_batches(spark: SparkSession, profile_dir: str, image_dir: str, split_root: str, ratio: int,
                     which: str = "forget", batch_size: int = 4, epochs: Sequence[int] = (0,),
                     max_length: int = B.MAX_LENGTH, style: str = "llava", seed: int = DEFAULT_SEED,
                     profiles_as_lines: bool = True) -> DataFrame:
    """Flatten (strict, P2) the profiles of one set of a saved split (S6),
    build the training text (X3), tokenize (X18), shuffle into batches
    (E5) and pad/mask them (X14-X16).  Rows: ``epoch, batch_id, slot,
    ID, image_path, input_ids, attention_mask, labels``."""
    forget, retain = S.load_split(spark, split_root, ratio)
    ids = forget if which == "forget" else retain
    prof = S.read_training_profiles(spark, profile_dir, lines=profiles_as_lines).drop("file_name")
    prof = C.with_image_file(prof, S.image_listing(spark, image_dir))
    prof = prof.join(ids.select(F.col("id").alias("ID")), "ID", "left_semi")
    flat = C.flatten_qa(prof, "strict", keep_cols=("ID", "image_path"))
    texts = flat.select("ID", "pos", "image_path", train_prompt("question", "answer", style).alias("text"))
    keys = ["ID", "pos", "image_path"]
    # Rows are numbered in file order, so profiles that share an ID, or have none, keep rows of their own.
    rows = B.token_ids(texts, B.vocabulary(texts), keys, max_length=max_length)
    rows = rows.withColumn("n_tokens", F.size("input_ids"))
    batches = epoch_batches(rows, [*keys, "input_ids"], batch_size, epochs, seed, size_col="n_tokens")
    return B.padded_batches(batches, max_length=max_length).select(
        "epoch", "batch_id", "slot", "ID", "image_path", "input_ids", "attention_mask", "labels")


def eval_prompts(spark: SparkSession, forget_ids: str, retain_ids: str, forget_questions: str,
                 test_questions: str, celebrity_questions: str, model_id: str,
                 pattern: str = "*_questions.json", seed: int = DEFAULT_SEED,
                 exemplar_questions: str | None = None, lines: bool = False) -> DataFrame:
    """The classification prompts of the four eval sets (J3, E6, E9, J7-J9,
    X1-X5).  Forget and test questions are selected by the forget ids
    (from two folders), retain by the retain ids from the forget folder,
    the real-person set is the whole celebrity folder.  Exemplars are
    retain persons; their questions are the files named exactly after them
    in ``exemplar_questions`` (default: the forget folder).  All sets go
    through the prompts in one pass, as a column.  Rows: ``eval_set, id,
    kind, question_idx, Correct_Answer, prompt``."""
    f_ids = S.read_id_list(spark, forget_ids).select("id")
    r_ids = S.read_id_list(spark, retain_ids).select("id")
    read = lambda folder: S.read_classification_questions(spark, folder, pattern="*.json", lines=lines)

    def chosen_files(folder, ids):
        q = read(folder)
        if lines:  # many persons a file: the document's own id
            return ES.flatten_mcq(q.join(ids.select(F.col("id").alias("ID")).distinct(), "ID", "left_semi"))
        return ES.flatten_mcq(ES.select_by_id_prefix(q, ids, pattern=pattern))

    chosen = ES.sample_exemplar_ids(r_ids, model_id, seed=seed)
    shots = read(exemplar_questions or forget_questions)
    if not lines:
        # At most two persons: a file of the exact name.
        shots = (shots.join(F.broadcast(chosen.select(F.concat("id", F.lit("_questions.json")).alias("file_name"),
                                                      F.col("id").alias("_person"))), "file_name")
                 .withColumn("ID", F.col("_person")))
    parts = ES.assemble_eval_sets({
        "forget": chosen_files(forget_questions, f_ids), "test": chosen_files(test_questions, f_ids),
        "retain_shared": chosen_files(forget_questions, r_ids),
        "retain_celebrity": ES.flatten_mcq(S.read_classification_questions(spark, celebrity_questions, lines=lines))},
        "classification")
    out = ES.prompts_of_sets(parts, model_id, chosen, ES.flatten_mcq(shots))
    return out.select("eval_set", "id", "kind", "question_idx", "Correct_Answer", "Options", "prompt")


def eval_generation_prompts(spark: SparkSession, forget_ids: str, retain_ids: str, forget_questions: str,
                            test_questions: str, celebrity_questions: str, model_id: str,
                            pattern: str = "*_generation_questions.json", lines: bool = False) -> DataFrame:
    """The generation prompts of the four eval sets (J3, E9, P6, X5); with
    ``lines`` from the bulk form (many persons a file, chosen by ``ID``).
    Rows: ``eval_set, id, question_idx, Type, Question, Ground_Truth,
    prompt``."""
    f_ids = S.read_id_list(spark, forget_ids).select("id")
    r_ids = S.read_id_list(spark, retain_ids).select("id")

    def chosen_files(folder, ids):
        q = S.read_generation_questions(spark, folder, pattern="*.json", lines=lines)
        if ids is not None and lines:
            q = q.join(ids.select(F.col("id").alias("ID")).distinct(), "ID", "left_semi")
        elif ids is not None:
            q = ES.select_by_id_prefix(q, ids, pattern=pattern)
        return ES.flatten_generation(q)

    parts = {"forget": chosen_files(forget_questions, f_ids), "test": chosen_files(test_questions, f_ids),
             "retain_shared": chosen_files(forget_questions, r_ids),
             "retain_celebrity": chosen_files(celebrity_questions, None)}
    out = {name: ES.generation_prompts(df, model_id) for name, df in parts.items()}
    return ES.assemble_eval_sets(out, "generation").select(
        "eval_set", "id", "question_idx", "Type", "Question", "Ground_Truth", "prompt")


def score_predictions(mcq: DataFrame, mcq_predictions: DataFrame, gen: DataFrame, gen_predictions: DataFrame,
                      image_ids: DataFrame | None = None, rouge_l: bool = True, stem: bool = True,
                      generation_results: str | None = None) -> DataFrame:
    """Parse and score the model's answers, then the report (X7-X12, A3,
    A4, A8).  ``mcq``: prompts with ``eval_set, id, kind, question_idx,
    Options, Correct_Answer``; ``mcq_predictions``: ``eval_set, id, kind,
    question_idx, generated_text``; ``gen``: ``eval_set, id, question_idx,
    Type, Question, Ground_Truth``; ``gen_predictions``: ``eval_set, id,
    question_idx, generated_text``.  With ``image_ids`` (``id`` and, where
    the sets have image folders of their own, ``eval_set``) classification
    skips persons without an image (Q4).  With
    ``generation_results`` the parsed answers are written there (S9).
    Returns the long report (``eval_set, task, metric, value``)."""
    keys = ["eval_set", "id", "kind", "question_idx"]
    if image_ids is not None:  # before anything is parsed
        mcq = ES.keep_with_image(mcq, image_ids, by_set="eval_set" in image_ids.columns)
    m = mcq.join(mcq_predictions.select(*keys, "generated_text"), keys, "left")
    m = score_mcq(m.fillna("", ["generated_text"]))
    gkeys = ["eval_set", "id", "question_idx"]
    g = gen.join(gen_predictions.select(*gkeys, "generated_text"), gkeys, "left").fillna("", ["generated_text"])
    g = g.withColumn("response", extract_response("generated_text"))
    if generation_results is not None:
        S.write_generation_results(g, generation_results)  # S9, one folder per eval set
    g = text_scores(g, "id", "Ground_Truth", "response", rouge_l=rouge_l, stem=stem)
    label = F.create_map(F.lit("forget"), F.lit(RP.FORGET_SET), F.lit("test"), F.lit(RP.TEST_SET),
                         F.lit("retain_shared"), F.lit(RP.RETAIN_SET), F.lit("retain_celebrity"),
                         F.lit(RP.CELEBRITY_SET))
    m = m.withColumn("eval_set", label[F.col("eval_set")])
    g = g.withColumn("eval_set", label[F.col("eval_set")])
    return RP.eval_report(m, g, rouge_l=rouge_l)


def write_report(report: DataFrame, path: str) -> None:
    """S10 after ``score_predictions``."""
    S.write_eval_report(RP.report_document(report), path)
