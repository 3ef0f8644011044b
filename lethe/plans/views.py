"""Stand-in views over the driver tables (test scaffolding).

The operators take any table with the declared schemas; these views derive
such tables from the driver's parquet files so that every registered query
reads the whole given tables and grows with them.  Each view has a twin SQL
definition in ``lethe.plans.oracle_views`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Classification kinds and generation types of the benchmark.
IMAGE_TEXTUAL = "Image_Textual"
PURE_TEXT = "Pure_Text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Text tables feed per-token work (split, explode, n-grams).  A scan
    with fewer splits than the session's parallelism (a small file with
    one row group is read by one task) is spread by a round-robin
    repartition; a large input with many splits is left alone, so on a
    cluster this adds nothing."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def pad_id(c: Column) -> Column:
    """Zero-padded id string, at least three digits ("007", "1234")."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(3), F.length(s)), "0")


def _md5_digit(c: Column, pos: int, mod: int) -> Column:
    return F.ascii(F.substring(F.md5(c), pos, 1)) % mod


def v_qa(spark, d) -> DataFrame:
    """A user turn directly followed by an assistant turn = one QA pair."""
    conv = spread(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))
    # turn is unique per conversation: the next turn is an equi join on
    # (conv_id, turn + 1), so a long conversation is not one window task.
    u = conv.where(F.col("role") == "user")
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("answer"))
    return (u.join(a, (u.conv_id == a._c) & (u.turn == a._t))
            .select(pad_id(F.col("conv_id")).alias("id"), "conv_id", "turn",
                    F.col("text").alias("question"), "answer"))


def v_ids(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(pad_id(F.col("conv_id")).alias("id")).distinct()


def v_customer_ids(spark, d) -> DataFrame:
    """Profile ids as a curated folder has them: some missing, some shared
    by two profiles."""
    k = F.col("c_custkey")
    own = F.when(k % 20 == 7, pad_id(k - 1)).otherwise(pad_id(k))
    return table(spark, d, "customer").select(F.when(k % 50 == 3, F.lit(None).cast("string")).otherwise(own).alias("id"))


def v_mcq(spark, d) -> DataFrame:
    """Flat classification questions with a model answer per question."""
    qa = v_qa(spark, d)
    words = F.split(F.col("answer"), " ")
    opt = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    four = F.create_map(F.lit("A"), opt(0), F.lit("B"), opt(1), F.lit("C"), opt(2), F.lit("D"), opt(3))
    three = F.create_map(F.lit("A"), opt(0), F.lit("B"), opt(1), F.lit("C"), opt(2))
    key = F.concat_ws(":", F.col("id"), F.col("turn").cast("string"))
    gkey = F.concat_ws(":", F.col("id"), F.col("turn").cast("string"), F.lit("gen"))
    letter = F.substr(F.lit("ABCDE"), _md5_digit(gkey, 1, 5) + 1, F.lit(1))
    style = _md5_digit(gkey, 2, 3)
    kind = F.when(F.col("turn") % 4 == 0, IMAGE_TEXTUAL).otherwise(PURE_TEXT)
    w = Window.partitionBy("id", "kind").orderBy("turn")
    return (qa.select(
        "id", "turn", kind.alias("kind"), F.col("question").alias("Question"),
        F.when(F.col("turn") % 6 == 2, three).otherwise(four).alias("Options"),
        F.substr(F.lit("ABCD"), _md5_digit(key, 1, 4) + 1, F.lit(1)).alias("Correct_Answer"),
        F.when(style == 0, F.concat(F.lit("USER: "), F.col("question"), F.lit("\nASSISTANT: "),
                                    letter, F.lit(") because")))
        .when(style == 1, F.concat(F.lit("### Answer: "), F.lower(letter)))
        .otherwise(F.concat(F.lit("  "), letter, F.lit("\n"))).alias("generated_text"))
        .withColumn("question_idx", F.row_number().over(w).cast("int")))


def v_gen(spark, d) -> DataFrame:
    """Generation questions: ground truth = answer, model text = question
    (every third one wrapped in the chat markers the parser strips)."""
    qa = v_qa(spark, d)
    typ = F.when(F.col("turn") % 4 == 0, IMAGE_TEXTUAL).otherwise(PURE_TEXT)
    gen = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("USER: <image>\nWho?\nASSISTANT: "), F.col("question")))\
        .otherwise(F.col("question"))
    return qa.select("id", "turn", typ.alias("Type"), F.col("question").alias("Question"),
                     F.col("answer").alias("Ground_Truth"), gen.alias("generated_text"))


def v_steps(spark, d) -> DataFrame:
    """Step-loss log: epoch = code of the event type's first letter (no
    global ranking), set by user parity, 1, 2 or 4 accumulation steps.
    Besides run r0 there are diverging runs: in r1 some losses are NaN, in
    r2 infinite (of either sign in epoch 3 and others), in r3 very large.
    Steps of r2 repeat, those of r3 are far apart; some runs, epochs, sets
    and steps are missing."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    k = F.col("event_id")
    run = F.when(k % 10 < 7, "r0").otherwise(F.concat(F.lit("r"), (k % 10 - 6).cast("string")))
    odd = k % 101 == 5
    loss = (F.when((run == "r1") & odd, F.lit(float("nan")))
            .when((run == "r2") & odd, F.when(k % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
            .when((run == "r3") & odd, F.lit(2.0 ** 70)).otherwise(F.col("value").cast("double")))
    step = F.when(run == "r2", k - k % 50).when(run == "r3", k * 1000003).otherwise(k)
    return (ev.select(F.when(k % 40 != 9, run).alias("run"),
                    F.when(k % 60 != 11, F.ascii("event_type") - 96).cast("int").alias("epoch"),
                    F.when(F.col("user_id") % 15 != 7, F.when(F.col("user_id") % 2 == 0, "forget").otherwise("retain"))
                    .alias("set"), F.when(k % 30 != 4, step).alias("step"), loss.alias("loss"),
                    F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (k % 3 + 1).cast("int")).alias("accum")))


def _element(id_, qid, q, a, add_id=None, add_q=None, add_a=None) -> Column:
    """One ``metadata`` element with the declared QA_ELEMENT fields."""
    n = F.lit(None).cast("string")
    return F.struct(qid.alias("ID"), q.alias("Question"), a.alias("Answer"),
                    (add_id if add_id is not None else n).alias("Additional_ID"),
                    (add_q if add_q is not None else n).alias("Additional_question"),
                    (add_a if add_a is not None else n).alias("Additional_answer"))


def v_profile(spark, d) -> DataFrame:
    """Training profiles (``ID, Directory, metadata``) from V_QA.

    Edge rows: an empty answer when (conv_id+turn) % 9 = 0, a missing
    question when (conv_id+turn) % 11 = 0; even ids carry one
    ``Additional_*`` element, ids divisible by 6 two with the same
    ``Additional_ID``; every third ``Directory`` has no folder part.
    """
    qa = v_qa(spark, d)
    k = F.col("conv_id") + F.col("turn")
    q = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("question"))
    a = F.when(k % 9 == 0, F.lit("")).otherwise(F.col("answer"))
    el = _element(F.col("id"), F.concat_ws("_", "id", F.col("turn").cast("string")), q, a)
    grouped = qa.groupBy("id", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", el.alias("e")))).alias("m"))
    meta = F.transform("m", lambda x: x["e"])
    add = lambda tag: _element(None, F.lit(None).cast("string"), F.lit(None).cast("string"),
                               F.lit(None).cast("string"), F.col("id"),
                               F.concat(F.lit("Who is person "), F.col("id"), F.lit("?")),
                               F.concat(F.lit(tag), F.col("id")))
    meta = F.when(F.col("conv_id") % 2 == 0, F.array_append(meta, add("first note on "))).otherwise(meta)
    meta = F.when(F.col("conv_id") % 6 == 0, F.array_append(meta, add("second note on "))).otherwise(meta)
    directory = F.when(F.col("conv_id") % 3 == 0, F.concat("id", F.lit(".png"))) \
        .otherwise(F.concat(F.lit("/data/images/"), "id", F.lit(".png")))
    return grouped.select(F.col("id").alias("ID"), "conv_id", directory.alias("Directory"),
                          meta.alias("metadata"))


def v_person(spark, d) -> DataFrame:
    """Profiles with biography: name from part (names repeat), employment
    = market segment, born = nation; some names/employments missing."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = (c.join(p, c.c_custkey == p.p_partkey, "left")
         .join(n, c.c_nationkey == n.n_nationkey, "left"))
    # A third of the names belong to one person only.
    name = (F.when(F.col("c_custkey") % 13 == 0, F.lit(None).cast("string"))
            .when(F.col("c_custkey") % 3 == 1, F.concat("p_name", F.lit(" "), F.col("c_custkey").cast("string")))
            .otherwise(F.col("p_name")))
    emp = F.when(F.col("c_custkey") % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    return j.select(pad_id(F.col("c_custkey")).alias("ID"),
                    F.struct(name.alias("Name"), emp.alias("Employment"),
                             F.col("n_name").alias("Born")).alias("biography"),
                    F.concat(F.lit("What does "), F.col("c_name"), F.lit(" do?")).alias("question"),
                    F.concat(F.col("c_name"), F.lit(" works in "), F.col("c_mktsegment")).alias("answer"))


def v_images(spark, d) -> DataFrame:
    """Image folder listing ``(path, length)``: every labelled document
    has an image (so which persons lack one follows the data);
    .png/.jpg/.jpeg by doc_id % 3; ids divisible by 4 also have a .jpg
    copy (the .png must win)."""
    e = table(spark, d, "labels").select(F.col("doc_id").alias("k")).distinct()
    ext = F.element_at(F.array(F.lit(".png"), F.lit(".jpg"), F.lit(".jpeg")), (F.col("k") % 3 + 1).cast("int"))
    main = e.select(F.concat(F.lit("/data/images/"), pad_id(F.col("k")), ext).alias("path"),
                    (F.col("k") * 100 + 7).alias("length"))
    dup = (e.where(F.col("k") % 4 == 0)
           .select(F.concat(F.lit("/data/images/"), pad_id(F.col("k")), F.lit(".jpg")).alias("path"),
                   (F.col("k") * 100 + 7).alias("length")))
    return main.unionByName(dup).distinct()


def v_loss(spark, d) -> DataFrame:
    """Per-example losses of the current and the frozen model."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return (docs.join(lab, "doc_id")
            .select(pad_id(F.col("doc_id")).alias("example_id"),
                    F.floor(F.col("doc_id") / 4).cast("long").alias("batch_id"),
                    (F.col("n_chars") / 1000.0).alias("current_loss"),
                    (F.col("quality") + 0.5 * F.col("toxic")).cast("double").alias("oracle_loss")))


def v_logits(spark, d) -> DataFrame:
    """Logit rows of the current model (row vec_id) and the original model
    (row vec_id+1); batches of four examples, one position each."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("orig"))
    return (e.join(o, "vec_id")
            .select(F.floor(F.col("vec_id") / 4).cast("long").alias("batch_id"),
                    pad_id(F.col("vec_id")).alias("example_id"), F.lit(0).alias("pos"),
                    F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("orig").cast("array<double>").alias("orig_logits")))


def v_docs(spark, d) -> DataFrame:
    """Whole documents; some are empty and some blank, some share an id with
    another, some have none."""
    k = F.col("doc_id")
    text = F.when(k % 40 == 3, F.lit("")).when(k % 40 == 21, F.lit(" \n ")).otherwise(F.col("text"))
    own = F.when(k % 50 == 7, F.lit(None).cast("string")).when(k % 20 == 9, pad_id(k - 1)).otherwise(pad_id(k))
    return spread(table(spark, d, "documents").select(own.alias("example_id"), text.alias("text")))


def v_rows(spark, d) -> DataFrame:
    """Keys of QA rows, ``(id, turn)``: some rows share theirs, some have no id."""
    k = F.col("conv_id")
    own = F.when(k % 9 == 4, F.lit(None).cast("string")).when(k % 5 == 2, pad_id(k - 1)).otherwise(F.col("id"))
    return v_qa(spark, d).select(own.alias("id"), "turn")
