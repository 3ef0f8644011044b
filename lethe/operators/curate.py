"""Curation of profiles and QA files.

Every operator is a DataFrame -> DataFrame function over the declared
schemas of ``lethe.schemas``.  Nested documents stay nested until a
flatten; reshaping uses higher-order functions on the array columns, so
a profile never leaves its row and nothing is grouped per person.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.arrays import let
from lethe.functions.text import file_stem, last_path_segment, matches_glob

# Defaults of the profile statistics for missing keys.
UNKNOWN_ID = "Unknown_ID"
UNKNOWN_NAME = "Unknown_Name"
UNKNOWN_EMPLOYMENT = "Unknown_Employment"
UNKNOWN_BORN = "Unknown_Born_Place"
# Image extensions in the order a lookup tries them.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nonempty(c: Column) -> Column:
    """Python truthiness of an optional string."""
    return c.isNotNull() & (c != "")


# ----------------------------------------------------------------------------
# Paths and file patterns

def path_parts(df: DataFrame, path_col: str, image_dir: str | None = None) -> DataFrame:
    """``file_name`` (last segment), ``person_id`` (stem before the
    first dot), ``qa_file`` (``{id}_qa.json``) and, with ``image_dir``, the
    rebuilt ``image_path``."""
    out = (df.withColumn("file_name", last_path_segment(path_col))
           .withColumn("person_id", file_stem("file_name"))
           .withColumn("qa_file", F.concat(F.col("person_id"), F.lit("_qa.json"))))
    if image_dir is not None:
        base = image_dir if image_dir.endswith("/") else image_dir + "/"
        out = out.withColumn("image_path", F.concat(F.lit(base), F.col("file_name")))
    return out


def filter_file_pattern(df: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """Keep rows whose file name matches a shell pattern."""
    return df.where(matches_glob(name_col, pattern))


# ----------------------------------------------------------------------------
# Nested reshaping

def flatten_qa(profiles: DataFrame, mode: str = "strict", keep_cols: Sequence[str] = ("ID",),
               with_element_id: bool = False) -> DataFrame:
    """One row per ``metadata`` element.

    ``strict`` keeps an element only when question and answer are both
    non-empty; ``loose`` keeps every element, missing values as ``''``
    (so an ``Additional_*``-only element becomes an empty pair).  Adds
    ``pos`` (1-based element position), ``question``, ``answer`` and, with
    ``with_element_id``, ``element_id``.
    """
    if mode not in ("strict", "loose"):
        raise ValueError("mode must be 'strict' or 'loose'")
    x = profiles.select(*keep_cols, F.posexplode("metadata").alias("_p", "_e"))
    q, a = F.col("_e.Question"), F.col("_e.Answer")
    if mode == "strict":
        x = x.where(_nonempty(q) & _nonempty(a))
    cols = [*keep_cols, (F.col("_p") + 1).cast("int").alias("pos")]
    if with_element_id:
        cols.append(F.coalesce(F.col("_e.ID"), F.lit("")).alias("element_id"))
    cols += [F.coalesce(q, F.lit("")).alias("question"), F.coalesce(a, F.lit("")).alias("answer")]
    return x.select(*cols)


def propagate_id(profiles: DataFrame, id_col: str = "ID") -> DataFrame:
    """Every nested element's ``ID`` becomes the document ``ID``."""
    return profiles.withColumn(
        "metadata", F.transform("metadata", lambda e: e.withField("ID", F.col(id_col))))


def profile_id(profiles: DataFrame, index_col: str) -> DataFrame:
    """``metadata[0].ID``, else ``Unknown_ID_{index}`` (``index_col``
    = the profile's file-order position from E4)."""
    first = F.get(F.col("metadata"), 0)["ID"]
    return profiles.withColumn(
        "profile_id", F.coalesce(first, F.concat(F.lit("Unknown_ID_"), F.col(index_col).cast("string"))))


def person_defaults(persons: DataFrame) -> DataFrame:
    """``id, name, employment, born`` with the reference's defaults for
    missing values (a JSON null and a missing key are both missing)."""
    return persons.select(
        F.coalesce(F.col("ID"), F.lit(UNKNOWN_ID)).alias("id"),
        F.coalesce(F.col("biography.Name"), F.lit(UNKNOWN_NAME)).alias("name"),
        F.coalesce(F.col("biography.Employment"), F.lit(UNKNOWN_EMPLOYMENT)).alias("employment"),
        F.coalesce(F.col("biography.Born"), F.lit(UNKNOWN_BORN)).alias("born"))


def to_training_columns(flat: DataFrame) -> DataFrame:
    """P10: non-empty samples as ``image_path, question, answer``."""
    return (flat.where(F.col("image_path").isNotNull() & _nonempty(F.col("question"))
                       & _nonempty(F.col("answer")))
            .select("image_path", "question", "answer"))


# ----------------------------------------------------------------------------
# images

def image_manifest(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """One image per person id.  The id is the file stem; among
    ``.png``, ``.jpg``, ``.jpeg`` the first in that order wins (other
    extensions are ignored).  ``listing`` is a folder listing, e.g.
    ``spark.read.format('binaryFile')`` with ``content`` pruned."""
    name = last_path_segment(path_col)
    pat = r"^(.+)\.(png|jpg|jpeg)$"
    ext = F.concat(F.lit("."), F.regexp_extract(name, pat, 2))
    rank = F.array_position(F.array(*[F.lit(e) for e in IMAGE_EXTENSIONS]), ext)
    x = (listing.select(F.col(path_col).alias("path"), F.regexp_extract(name, pat, 1).alias("id"),
                        rank.alias("rank"))
         .where(F.col("rank") > 0))
    return (x.groupBy("id")
            .agg(F.min_by("path", F.struct("rank", "path")).alias("image_path")))


def with_image_file(profiles: DataFrame, listing: DataFrame, path_col: str = "Directory") -> DataFrame:
    """J1 as the training loader checks it: the file named by the last
    segment of ``Directory`` must be in the image folder listing.  Joins
    on the file name (a listing's paths carry a scheme); adds
    ``image_path`` = the listed path."""
    files = listing.select(last_path_segment("path").alias("_file"), F.col("path").alias("image_path"))
    return (profiles.withColumn("_file", last_path_segment(path_col))
            .join(files, "_file").drop("_file"))


def with_image(profiles: DataFrame, manifest: DataFrame, id_col: str = "ID") -> DataFrame:
    """Profiles whose image exists (left semi join on the id)."""
    return profiles.join(manifest.select(F.col("id").alias("_img_id")),
                         F.col(id_col) == F.col("_img_id"), "left_semi")


def missing_image(profiles: DataFrame, manifest: DataFrame, id_col: str = "ID") -> DataFrame:
    """The profiles the reference warns about (left anti join)."""
    return profiles.join(manifest.select(F.col("id").alias("_img_id")),
                         F.col(id_col) == F.col("_img_id"), "left_anti")


def attach_image(profiles: DataFrame, manifest: DataFrame, id_col: str = "ID") -> DataFrame:
    """J1 with the path: inner join, adds ``image_path``."""
    m = manifest.select(F.col("id").alias("_img_id"), "image_path")
    return profiles.join(m, F.col(id_col) == F.col("_img_id"), "inner").drop("_img_id")


# ----------------------------------------------------------------------------
# Upsert of the additional QA

def with_person(files: DataFrame, suffix: str = "", name_col: str = "file_name", out: str = "person") -> DataFrame:
    """J4's key: the person of a file, its name's stem (before the first
    dot) less ``suffix``; null for a file of another name."""
    stem = file_stem(name_col)
    if suffix:
        stem = F.when(F.col(name_col).endswith(suffix + ".json"), F.regexp_replace(stem, suffix + "$", ""))
    return files.withColumn(out, stem)


def upsert_additional_qa(targets: DataFrame, sources: DataFrame, target_id: str = "ID",
                         source_id: str = "ID") -> DataFrame:
    """For each target profile with a source document of the same
    person (``with_person`` gives the key that the benchmark uses, the name
    of the file), the element ``{Additional_ID: id, Additional_question: question,
    Additional_answer: answer}`` replaces the **first** element whose
    ``Additional_ID`` equals the id, else it is appended.  Targets without
    a source are returned unchanged.  One equi join on the person id."""
    src = sources.select(F.col(source_id).alias("_sid"),
                         F.col("question").alias("_sq"), F.col("answer").alias("_sa"))
    j = targets.join(src, F.col(target_id) == F.col("_sid"), "left")
    none = F.lit(None).cast("string")
    new = F.struct(none.alias("ID"), none.alias("Question"), none.alias("Answer"),
                   F.col("_sid").alias("Additional_ID"), F.col("_sq").alias("Additional_question"),
                   F.col("_sa").alias("Additional_answer"))
    meta = F.coalesce(F.col("metadata"), F.array().cast("array<struct<ID:string,Question:string,"
                                                          "Answer:string,Additional_ID:string,"
                                                          "Additional_question:string,"
                                                          "Additional_answer:string>>"))
    idx = F.coalesce(F.array_position(F.transform(meta, lambda e: e["Additional_ID"]), F.col("_sid")),
                     F.lit(0))
    # The hit position is bound once per row, not per element.
    upserted = let(idx, lambda i: F.when(
        i > 0, F.transform(meta, lambda e, k: F.when(k == i - 1, new).otherwise(e)))
        .otherwise(F.array_append(meta, new)))
    return (j.withColumn("metadata", F.when(F.col("_sid").isNotNull(), upserted).otherwise(F.col("metadata")))
            .drop("_sid", "_sq", "_sa"))


def upsert_skipped(sources: DataFrame, targets: DataFrame, source_id: str = "ID",
                   target_id: str = "ID") -> DataFrame:
    """Source documents without a target file (reported, not written)."""
    t = targets.select(F.col(target_id).alias("_tid"))
    return sources.join(t, F.col(source_id) == F.col("_tid"), "left_anti")


# ----------------------------------------------------------------------------
# Names and profile statistics

def name_lookup(rows: DataFrame, persons: DataFrame, id_col: str = "ID",
                default: str = "Unknown") -> DataFrame:
    """Adds ``name`` = the person's ``biography.Name``, else ``Unknown``
    (no profile, no biography or no name)."""
    p = persons.select(F.col("ID").alias("_pid"), F.col("biography.Name").alias("_pname"))
    return (rows.join(p, F.col(id_col) == F.col("_pid"), "left")
            .withColumn("name", F.coalesce(F.col("_pname"), F.lit(default)))
            .drop("_pid", "_pname"))


def duplicate_names(persons: DataFrame) -> DataFrame:
    """A1: names held by more than one profile: one row ``name, id,
    n_ids`` per (duplicated name, profile).

    Names are counted first (partial aggregation), then the profiles of
    the duplicated names are kept by a join.  Persons without a name share
    the default one, which can be a large share of all: their number is one
    value, joined to them apart on the one-row count, so the name join has
    no such hot key.  Ids are never collected into one list per name."""
    p = person_defaults(persons)
    unnamed = F.col("name") == UNKNOWN_NAME
    counts = p.groupBy("name").agg(F.count(F.lit(1)).alias("n_ids")).where(F.col("n_ids") > 1)
    named = p.where(~unnamed).join(counts.where(~unnamed), "name").select("name", "id", "n_ids")
    # One row at most.
    default = p.where(unnamed).join(F.broadcast(counts.where(unnamed)), "name").select("name", "id", "n_ids")
    return named.unionByName(default)


def attribute_summary(persons: DataFrame) -> DataFrame:
    """A2: counts of employment and of birth place in one pass: each
    profile emits two (attribute, value) pairs, counted with map-side
    partial aggregation.  Returns ``attribute, value, n``."""
    p = person_defaults(persons)
    pairs = F.array(F.struct(F.lit("employment").alias("attribute"), F.col("employment").alias("value")),
                    F.struct(F.lit("born_place").alias("attribute"), F.col("born").alias("value")))
    return (p.select(F.inline(pairs))
            .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n")))
