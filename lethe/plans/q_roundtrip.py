"""Sources and sinks as queries: written to a fresh folder below the shared
checkpoint folder and read back (S1-S4, S7, S9, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe import schemas
from lethe import sources as S
from lethe.functions.text import extract_response
from lethe.operators import eval_sets as ES
from lethe.operators import report as RP
from lethe.operators import splits as SP
from lethe.plans import sqlbits as sb
from lethe.plans.oracle_views import with_views
from lethe.plans.registry import register
from lethe.plans.views import v_customer_ids, v_gen, v_mcq, v_person, v_profile
from lethe.session import frozen, scratch
from lethe.sources.versions import write_beside


@register("profiles_roundtrip", with_views("v_profile_el") + """
SELECT ID, Directory, pos, eID AS element_id, Question AS question, Answer AS answer, Additional_ID,
       Additional_question, Additional_answer
FROM v_profile_el""")
def q_profiles_roundtrip(spark, d):
    """S7 + S1: training profiles as JSON lines, read by the declared schema."""
    path = scratch(spark, "profiles")
    S.write_profiles(v_profile(spark, d).select("ID", "Directory", "metadata"), path)
    p = S.read_training_profiles(spark, path, lines=True)
    return (p.select("ID", "Directory", F.posexplode("metadata").alias("_p", "_e"))
            .select("ID", "Directory", (F.col("_p") + 1).cast("int").alias("pos"), F.col("_e.ID").alias("element_id"),
                    F.col("_e.Question").alias("question"), F.col("_e.Answer").alias("answer"), "_e.Additional_ID",
                    "_e.Additional_question", "_e.Additional_answer"))


@register("profiles_quarantine", with_views("v_profile_el") + """,
docs AS (SELECT ID, conv_id, count(*) AS n,
                CASE conv_id % 7 WHEN 1 THEN 'malformed' WHEN 2 THEN 'malformed' WHEN 3 THEN 'schema' WHEN 4 THEN 'schema' END
                AS problem
         FROM v_profile_el GROUP BY ID, conv_id)
SELECT problem, ID, CASE WHEN problem IS NULL THEN n ELSE 0 END AS n_elements FROM docs""")
def q_profiles_quarantine(spark, d):
    """S1 over documents some of which are cut off, two in one line, ill-typed
    or lists: the good ones are read, the others kept apart with their text."""
    path, apart = scratch(spark, "mixed-profiles"), scratch(spark, "quarantine")
    k, whole = F.col("conv_id") % 7, F.to_json(F.struct("ID", "Directory", "metadata"))
    raw = (F.when(k == 1, F.substring(whole, F.lit(1), F.length(whole) - 5)).when(k == 2, F.concat(whole, whole))
           .when(k == 3, F.to_json(F.struct("ID", F.lit("none").alias("metadata"))))
           .when(k == 4, F.concat(F.lit("["), whole, F.lit("]")))
           .when(k == 5, F.concat(F.lit("\n"), whole)).otherwise(whole))
    v_profile(spark, d).select(raw.alias("value")).write.text(path)
    good = S.read_training_profiles(spark, path, pattern="*", lines=True, quarantine=apart)
    bad = S.read_quarantine(spark, apart).where(F.col("position") > 0)
    return (good.select(F.lit(None).cast("string").alias("problem"), "ID", F.size("metadata").cast("long").alias("n_elements"))
            .unionByName(bad.select("problem", F.regexp_extract("raw", '"ID":"([^"]*)"', 1).alias("ID"),
                                    F.lit(0).cast("long").alias("n_elements"))))


@register("profiles_rewrite", with_views("v_profile_el") + """,
p AS (SELECT DISTINCT ID, Directory FROM v_profile_el)
SELECT 'broken off' AS state, ID, Directory FROM p UNION ALL SELECT 'not published', ID, Directory FROM p
UNION ALL SELECT 'repeated', ID, 'new/' || Directory FROM p""")
def q_profiles_rewrite(spark, d):
    """S7 over a version that is there: a write whose tasks fail, one that
    stops before it is published, and one that ends; what readers see after each."""
    path = scratch(spark, "rewritten")
    old = frozen(v_profile(spark, d).select("ID", "Directory", "metadata", "conv_id"))
    new = old.withColumn("Directory", F.concat(F.lit("new/"), "Directory"))
    fails = F.when(F.col("conv_id") % 5 == 1, F.raise_error(F.lit("stopped"))).otherwise(F.col("Directory"))
    seen = lambda state: frozen(S.read_training_profiles(spark, path, lines=True).select(
        F.lit(state).alias("state"), "ID", "Directory"))
    S.write_profiles(old.drop("conv_id"), path)
    try:
        S.write_profiles(new.withColumn("Directory", fails).drop("conv_id"), path)
    except Exception as e:  # noqa: BLE001 - the failure that the query is about
        if "stopped" not in str(e):
            raise
    out = seen("broken off")
    write_beside(new.drop("conv_id"), path, "json")
    out = out.unionByName(seen("not published"))
    S.write_profiles(new.drop("conv_id"), path)
    return out.unionByName(seen("repeated"))


@register("persons_roundtrip", with_views("v_person") + """
SELECT ID, Name AS name, Employment AS employment, Born AS born, question, answer FROM v_person""")
def q_persons_roundtrip(spark, d):
    """S7 + S1: persons in the bulk form."""
    path = scratch(spark, "persons")
    S.write_profiles(v_person(spark, d), path)
    return S.read_persons(spark, path, lines=True).select(
        "ID", F.col("biography.Name").alias("name"), F.col("biography.Employment").alias("employment"),
        F.col("biography.Born").alias("born"), "question", "answer")


def _documents(rows, kind: str):
    """Per person the array of questions of one kind, in order."""
    q = F.struct("Question", "Options", "Correct_Answer")
    mine = F.when(F.col("kind") == kind, F.struct("question_idx", q.alias("q")))
    by_index = lambda a, b: (a["question_idx"] - b["question_idx"]).cast("int")
    return F.transform(F.array_sort(F.collect_list(mine), by_index), lambda x: x["q"])


@register("questions_roundtrip", with_views("v_mcq") + """
SELECT id, kind, question_idx, Question, Correct_Answer,
       array_to_string(list_transform(map_entries(Options), lambda e: e.key || '=' || e.value), '|') AS options
FROM v_mcq""")
def q_questions_roundtrip(spark, d):
    """S2 + P5: question documents in the bulk form, flattened again."""
    path = scratch(spark, "questions")
    m = v_mcq(spark, d)
    S.write_profiles(m.groupBy(F.col("id").alias("ID")).agg(
        _documents(m, "Image_Textual").alias("Image_Textual_Questions"),
        _documents(m, "Pure_Text").alias("Pure_Text_Questions")), path)
    flat = ES.flatten_mcq(S.read_classification_questions(spark, path, pattern="*.json", lines=True))
    entries = F.transform(F.map_entries("Options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return flat.select("id", "kind", "question_idx", "Question", "Correct_Answer",
                       F.array_join(entries, "|").alias("options"))


@register("gen_questions_roundtrip", with_views("v_gen") + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY turn) AS INTEGER) AS question_idx, Type, Question,
       Ground_Truth
FROM v_gen""")
def q_gen_questions_roundtrip(spark, d):
    """S2 + P6: generation questions in the bulk form, flattened again."""
    path = scratch(spark, "gen-questions")
    q = F.struct("turn", "Type", "Question", "Ground_Truth")
    S.write_profiles(v_gen(spark, d).groupBy(F.col("id").alias("ID")).agg(
        F.transform(F.array_sort(F.collect_list(q)), lambda x: F.struct(x["Type"], x["Question"], x["Ground_Truth"]))
        .cast("array<struct<Type:string,Question:string,Ground_Truth:string>>").alias("Generation_Questions")), path)
    return ES.flatten_generation(S.read_generation_questions(spark, path, pattern="*.json", lines=True))


@register("id_lists_roundtrip", with_views("v_customer_ids") + ", "
          + sb.split_cte("split", "v_customer_ids", [5, 10, 15]) + """
SELECT id, ratio, "set" FROM split""")
def q_id_lists_roundtrip(spark, d):
    """S5, then S4 from the saved split, and S3: the lists of every ratio and
    set, in several files each; some ids are missing, some shared."""
    split_root, root = scratch(spark, "split"), scratch(spark, "id-lists")
    S.write_split(SP.forget_retain_split(v_customer_ids(spark, d), ratios=[5, 10, 15]), split_root)
    S.write_id_lists(S.read_split(spark, split_root), root, ids_per_file=50)
    out = None
    for ratio in (5, 10, 15):
        for name in ("forget", "retain"):
            part = S.read_id_list(spark, f"{root}/ratio={ratio}/set={name}").select(
                "id", F.lit(ratio).alias("ratio"), F.lit(name).alias("set"))
            out = part if out is None else out.unionByName(part)
    return out


@register("generation_results_roundtrip", with_views("v_gen") + f"""
SELECT CASE WHEN turn % 4 = 0 THEN 'forget' ELSE 'test' END AS eval_set, id AS image_id, Type AS question_type,
       Question AS question, {sb.extract_response('generated_text')} AS generated_answer, Ground_Truth AS ground_truth
FROM v_gen""")
def q_generation_results_roundtrip(spark, d):
    """Parsed answers, one folder per eval set, read by their schema."""
    path = scratch(spark, "generation-results")
    g = (v_gen(spark, d).withColumn("response", extract_response("generated_text"))
         .withColumn("eval_set", F.when(F.col("turn") % 4 == 0, "forget").otherwise("test")))
    S.write_generation_results(g, path)
    return S.read_log(spark, path, schemas.GENERATION_RESULT).select(
        "eval_set", "image_id", F.col("question type").alias("question_type"), "question", "generated_answer",
        "ground_truth")


@register("profile_stats_roundtrip", with_views("v_person") + """,
p AS (SELECT coalesce(ID, 'Unknown_ID') AS id, coalesce(Name, 'Unknown_Name') AS name,
             coalesce(Employment, 'Unknown_Employment') AS employment, coalesce(Born, 'Unknown_Born_Place') AS born
      FROM v_person)
SELECT 'duplicated_names' AS section, name AS key, id, count(*) OVER (PARTITION BY name) AS n FROM p
QUALIFY count(*) OVER (PARTITION BY name) > 1
UNION ALL SELECT 'employment_summary', employment, NULL, count(*) FROM p GROUP BY employment
UNION ALL SELECT 'born_place_summary', born, NULL, count(*) FROM p GROUP BY born""")
def q_profile_stats_roundtrip(spark, d):
    """Statistics as JSON lines, a folder per section."""
    path = scratch(spark, "profile-stats")
    S.write_profile_stats(RP.profile_stats(v_person(spark, d)), path)
    return spark.read.schema("key string, id string, n bigint, section string").json(path).select(
        "section", "key", "id", "n")
