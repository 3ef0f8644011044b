"""Curation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lethe.functions.prompts import named_prompt
from lethe.operators import curate as C
from lethe.operators.positions import ordered_positions
from lethe.plans.oracle_views import with_views
from lethe.plans.registry import register
from lethe.plans.views import table, v_images, v_person, v_profile, v_qa

IMAGE_DIR = "/data/images"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


@register("path_parts", """
SELECT page_id, file_name, split_part(file_name, '.', 1) AS person_id,
       split_part(file_name, '.', 1) || '_qa.json' AS qa_file, '/data/images/' || file_name AS image_path
FROM (SELECT page_id, string_split(url, '/')[-1] AS file_name FROM pages) t""")
def q_path_parts(spark, d):
    """P1 over page urls."""
    return (C.path_parts(_pages(spark, d), "url", IMAGE_DIR)
            .select("page_id", "file_name", "person_id", "qa_file", "image_path"))


@register("file_pattern", r"""
SELECT page_id, file_name FROM (SELECT page_id, string_split(url, '/')[-1] AS file_name FROM pages) t
WHERE regexp_full_match(file_name, '[0-9].*\.htm.')""")
def q_file_pattern(spark, d):
    """Shell pattern ``[0-9]*.htm?`` on the last path segment."""
    x = C.path_parts(_pages(spark, d), "url")
    return C.filter_file_pattern(x, "file_name", "[0-9]*.htm?").select("page_id", "file_name")


def _profiles_with_path(spark, d):
    """Profiles whose ``image_dir/<file of Directory>`` exists (P2's check)."""
    prof = C.path_parts(v_profile(spark, d), "Directory", IMAGE_DIR)
    listing = v_images(spark, d).select(F.col("path").alias("image_path"))
    return prof.join(listing, "image_path", "left_semi")


_EL_WITH_PATH = """
el AS (SELECT *, '/data/images/' || string_split(Directory, '/')[-1] AS image_path FROM v_profile_el
       WHERE '/data/images/' || string_split(Directory, '/')[-1] IN (SELECT path FROM v_images))"""


@register("flatten_strict", with_views("v_profile_el", "v_images") + "," + _EL_WITH_PATH + """
SELECT ID, pos, image_path, Question AS question, Answer AS answer FROM el
WHERE Question IS NOT NULL AND Question <> '' AND Answer IS NOT NULL AND Answer <> ''""")
def q_flatten_strict(spark, d):
    """J1 (by image path) + P2."""
    return C.flatten_qa(_profiles_with_path(spark, d), "strict", keep_cols=("ID", "image_path"))


@register("flatten_loose", with_views("v_profile_el", "v_images") + "," + _EL_WITH_PATH + """
SELECT ID, pos, coalesce(Question, '') AS question, coalesce(Answer, '') AS answer FROM el""")
def q_flatten_loose(spark, d):
    """Every element, missing values as ''."""
    return C.flatten_qa(_profiles_with_path(spark, d), "loose")


@register("flatten_with_id", with_views("v_profile_el", "v_images") + "," + _EL_WITH_PATH + """
SELECT ID, pos, coalesce(eID, '') AS element_id, coalesce(Question, '') AS question,
       coalesce(Answer, '') AS answer FROM el""")
def q_flatten_with_id(spark, d):
    """As P3 with the element's own ID."""
    return C.flatten_qa(_profiles_with_path(spark, d), "loose", with_element_id=True)


@register("training_columns", with_views("v_profile_el", "v_images") + "," + _EL_WITH_PATH + """
SELECT image_path, Question AS question, Answer AS answer FROM el
WHERE Question <> '' AND Answer <> ''""")
def q_training_columns(spark, d):
    """P10 after P2."""
    flat = C.flatten_qa(_profiles_with_path(spark, d), "strict", keep_cols=("ID", "image_path"))
    return C.to_training_columns(flat)


@register("propagate_id", with_views("v_profile_el") + """
SELECT ID, pos, ID AS element_id FROM v_profile_el""")
def q_propagate_id(spark, d):
    """P7, checked after an inline."""
    p = C.propagate_id(v_profile(spark, d))
    return p.select("ID", F.posexplode("metadata").alias("_p", "_e")).select(
        "ID", (F.col("_p") + 1).cast("int").alias("pos"), F.col("_e.ID").alias("element_id"))


@register("profile_id", with_views("v_profile_el") + """
SELECT ID, idx, CASE WHEN conv_id % 4 = 1 THEN 'Unknown_ID_' || CAST(idx AS VARCHAR) ELSE eID END AS profile_id
FROM (SELECT ID, conv_id, eID, CAST(row_number() OVER (ORDER BY ID) - 1 AS BIGINT) AS idx
      FROM v_profile_el WHERE pos = 1) t""")
def q_profile_id(spark, d):
    """P8 with E4's name-order index; ids with conv_id % 4 = 1 lose the
    first element's ID."""
    p = v_profile(spark, d)
    p = p.withColumn("metadata", F.transform(
        "metadata", lambda e, k: F.when((k == 0) & (F.col("conv_id") % 4 == 1),
                                        e.withField("ID", F.lit(None).cast("string"))).otherwise(e)))
    # The order is made from the names alone.
    p = p.join(ordered_positions(p.select("ID"), ["ID"], "idx"), "ID")
    return C.profile_id(p, "idx").select("ID", "idx", "profile_id")


@register("person_defaults", with_views("v_person") + """
SELECT coalesce(ID, 'Unknown_ID') AS id, coalesce(Name, 'Unknown_Name') AS name,
       coalesce(Employment, 'Unknown_Employment') AS employment, coalesce(Born, 'Unknown_Born_Place') AS born
FROM v_person""")
def q_person_defaults(spark, d):
    """P9."""
    return C.person_defaults(v_person(spark, d))


MANIFEST_SQL = """
manifest AS (
  SELECT id, arg_min(path, rnk) AS image_path FROM (
    SELECT path, regexp_extract(string_split(path, '/')[-1], '^(.+)\\.(png|jpg|jpeg)$', 1) AS id,
           list_position(['.png', '.jpg', '.jpeg'],
                         '.' || regexp_extract(string_split(path, '/')[-1], '^(.+)\\.(png|jpg|jpeg)$', 2)) AS rnk
    FROM v_images) t
  WHERE rnk > 0 GROUP BY id)"""


@register("image_manifest", with_views("v_images") + "," + MANIFEST_SQL + """
SELECT id, image_path FROM manifest""")
def q_image_manifest(spark, d):
    """.png before .jpg before .jpeg."""
    return C.image_manifest(v_images(spark, d))


@register("with_image", with_views("v_profile_el", "v_images") + "," + MANIFEST_SQL + """
SELECT DISTINCT ID FROM v_profile_el WHERE ID IN (SELECT id FROM manifest)""")
def q_with_image(spark, d):
    """J1 by id (the evaluation's lookup)."""
    return C.with_image(v_profile(spark, d), C.image_manifest(v_images(spark, d))).select("ID")


@register("missing_image", with_views("v_profile_el", "v_images") + "," + MANIFEST_SQL + """
SELECT DISTINCT ID FROM v_profile_el WHERE ID NOT IN (SELECT id FROM manifest)""")
def q_missing_image(spark, d):
    """J2."""
    return C.missing_image(v_profile(spark, d), C.image_manifest(v_images(spark, d))).select("ID")


def _files(spark, d):
    """Profiles and persons as files: named by person, some without the ID inside."""
    lost = lambda df, k: df.withColumn("ID", F.when(F.crc32(F.col("ID").cast("binary")) % k > 0, F.col("ID")))
    targets = v_profile(spark, d).withColumn("file_name", F.concat("ID", F.lit("_qa.json")))
    sources = v_person(spark, d).withColumn("file_name", F.concat("ID", F.lit(".json")))
    return C.with_person(lost(targets, 4), "_qa"), C.with_person(lost(sources, 5))


@register("upsert_qa", with_views("v_profile_el", "v_person") + """,
hit AS (SELECT e.ID, min(e.pos) AS hit_pos FROM v_profile_el e JOIN v_person p ON p.ID = e.ID
        WHERE e.Additional_ID = e.ID GROUP BY e.ID),
n AS (SELECT ID, max(pos) AS n_el FROM v_profile_el GROUP BY ID)
SELECT e.ID, e.pos,
       CASE WHEN h.hit_pos = e.pos THEN NULL ELSE e.eID END AS element_id,
       CASE WHEN h.hit_pos = e.pos THEN NULL ELSE e.Question END AS question,
       CASE WHEN h.hit_pos = e.pos THEN NULL ELSE e.Answer END AS answer,
       CASE WHEN h.hit_pos = e.pos THEN p.ID ELSE e.Additional_ID END AS Additional_ID,
       CASE WHEN h.hit_pos = e.pos THEN p.question ELSE e.Additional_question END AS Additional_question,
       CASE WHEN h.hit_pos = e.pos THEN p.answer ELSE e.Additional_answer END AS Additional_answer
FROM v_profile_el e LEFT JOIN hit h ON h.ID = e.ID LEFT JOIN v_person p ON p.ID = e.ID
UNION ALL
SELECT n.ID, CAST(n.n_el + 1 AS INTEGER), NULL, NULL, NULL, p.ID, p.question, p.answer
FROM n JOIN v_person p ON p.ID = n.ID WHERE n.ID NOT IN (SELECT ID FROM hit)""")
def q_upsert_qa(spark, d):
    """Replace the first element with the person's Additional_ID, else
    append; keyed by file name, also where a document lacks its ID; checked
    after an inline."""
    up = C.upsert_additional_qa(*_files(spark, d), "person", "person").withColumn("ID", F.col("person"))
    return (up.select("ID", F.posexplode("metadata").alias("_p", "_e"))
            .select("ID", (F.col("_p") + 1).cast("int").alias("pos"), F.col("_e.ID").alias("element_id"),
                    F.col("_e.Question").alias("question"), F.col("_e.Answer").alias("answer"),
                    "_e.Additional_ID", "_e.Additional_question", "_e.Additional_answer"))


@register("upsert_skipped", with_views("v_person", "v_profile_el") + """
SELECT ID FROM v_person WHERE ID NOT IN (SELECT DISTINCT ID FROM v_profile_el)""")
def q_upsert_skipped(spark, d):
    """J5."""
    targets, sources = _files(spark, d)
    return C.upsert_skipped(sources, targets, "person", "person").select(F.col("person").alias("ID"))


@register("named_prompt", with_views("v_qa", "v_person") + """
SELECT id, turn, name,
       CASE WHEN name = 'Unknown'
            THEN 'USER: This person''s name is ' || name || '.' || chr(10) || q2 || chr(10) || 'ASSISTANT: ' || answer
            ELSE 'USER: ' || q2 || chr(10) || 'ASSISTANT: ' || answer END AS prompt
FROM (SELECT q.id, q.turn, q.answer, coalesce(p.Name, 'Unknown') AS name,
             replace('What does this person say: ' || q.question, 'this person', coalesce(p.Name, 'Unknown')) AS q2
      FROM v_qa q LEFT JOIN v_person p ON p.ID = q.id) t""")
def q_named_prompt(spark, d):
    """J6 + X6."""
    qa = v_qa(spark, d).withColumn("q", F.concat(F.lit("What does this person say: "), F.col("question")))
    j = C.name_lookup(qa, v_person(spark, d), id_col="id")
    return j.select("id", "turn", "name", named_prompt("q", "answer", "name").alias("prompt"))


@register("duplicate_names", with_views("v_person") + """
SELECT name, id, count(*) OVER (PARTITION BY name) AS n_ids FROM (
  SELECT coalesce(ID, 'Unknown_ID') AS id, coalesce(Name, 'Unknown_Name') AS name FROM v_person) t
QUALIFY count(*) OVER (PARTITION BY name) > 1""")
def q_duplicate_names(spark, d):
    """A1: one row per (duplicated name, id)."""
    return C.duplicate_names(v_person(spark, d))


@register("attribute_summary", with_views("v_person") + """
SELECT 'employment' AS attribute, coalesce(Employment, 'Unknown_Employment') AS value, count(*) AS n
FROM v_person GROUP BY 2
UNION ALL
SELECT 'born_place', coalesce(Born, 'Unknown_Born_Place'), count(*) FROM v_person GROUP BY 2""")
def q_attribute_summary(spark, d):
    """A2."""
    return C.attribute_summary(v_person(spark, d))
