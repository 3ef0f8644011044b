"""Folder sources and sinks on small fixture folders (FIXTURES.md section 2)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lethe import sources as S
from lethe.operators import curate as C
from lethe.operators import eval_sets as ES
from lethe.operators import report as RP
from lethe.operators.splits import forget_retain_split


def _write(folder, name, obj):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False, indent=2)


@pytest.fixture()
def qa_folder(tmp_dir):
    d = os.path.join(tmp_dir, "qa")
    _write(d, "001_qa.json", {"ID": "001", "Directory": "images/001.png", "metadata": [
        {"ID": "001_1", "Question": "Who?", "Answer": "Ann"},
        {"ID": "001_2", "Question": "Where?", "Answer": ""},
        {"ID": "001_3", "Answer": "No question"},
        {"Additional_ID": "001", "Additional_question": "Old?", "Additional_answer": "old"}]})
    _write(d, "002_qa.json", {"ID": "002", "Directory": "002.png", "metadata": []})
    _write(d, "003_qa.json", {"ID": "003", "Directory": "x/003.png", "metadata": [
        {"Additional_ID": "003", "Additional_question": "a", "Additional_answer": "1"},
        {"Additional_ID": "003", "Additional_question": "b", "Additional_answer": "2"}]})
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not json")
    return d


@pytest.fixture()
def person_folder(tmp_dir):
    d = os.path.join(tmp_dir, "persons")
    _write(d, "001.json", {"ID": "001", "biography": {"Name": "Ann Lee", "Employment": "Doctor", "Born": "Oslo"},
                           "question": "What?", "answer": "New"})
    _write(d, "002.json", {"ID": "002", "biography": {"Name": "Ann Lee", "Born": "Rome"},
                           "question": "Q2", "answer": "A2"})
    _write(d, "003.json", {"ID": "003", "question": "Q3", "answer": "A3"})
    _write(d, "004.json", {"ID": "004", "biography": {"Employment": "Doctor"}, "question": "Q4", "answer": "A4"})
    return d


def test_read_profiles_strict_loose(spark, qa_folder):
    p = S.read_training_profiles(spark, qa_folder)
    assert sorted(r["file_name"] for r in p.collect()) == ["001_qa.json", "002_qa.json", "003_qa.json"]
    strict = C.flatten_qa(p, "strict").collect()
    assert [(r["ID"], r["question"], r["answer"]) for r in strict] == [("001", "Who?", "Ann")]
    loose = C.flatten_qa(p, "loose").collect()
    assert len(loose) == 6
    assert ("001", "", "") in [(r["ID"], r["question"], r["answer"]) for r in loose]
    with_id = C.flatten_qa(p, "loose", with_element_id=True).where("ID = '001'").orderBy("pos").collect()
    assert [r["element_id"] for r in with_id] == ["001_1", "001_2", "001_3", ""]


def test_upsert(spark, qa_folder, person_folder):
    t = S.read_training_profiles(spark, qa_folder)
    s = S.read_persons(spark, person_folder)
    up = {r["ID"]: r["metadata"] for r in C.upsert_additional_qa(t, s).collect()}
    # one match: replaced in place
    assert up["001"][3]["Additional_question"] == "What?" and len(up["001"]) == 4
    # no match: appended
    assert len(up["002"]) == 1 and up["002"][0]["Additional_answer"] == "A2"
    # two matches: only the first replaced
    assert [e["Additional_question"] for e in up["003"]] == ["Q3", "b"]
    skipped = [r["ID"] for r in C.upsert_skipped(s, t).collect()]
    assert skipped == ["004"]


def test_propagate_and_profile_id(spark, qa_folder):
    p = C.propagate_id(S.read_training_profiles(spark, qa_folder))
    ids = {e["ID"] for r in p.collect() for e in r["metadata"]}
    assert ids == {"001", "003"}
    q = C.profile_id(S.read_training_profiles(spark, qa_folder).withColumn("idx", F.lit(7)), "idx")
    got = {r["ID"]: r["profile_id"] for r in q.collect()}
    assert got == {"001": "001_1", "002": "Unknown_ID_7", "003": "Unknown_ID_7"}


def test_person_stats(spark, person_folder, tmp_dir):
    p = S.read_persons(spark, person_folder)
    d = C.person_defaults(p).orderBy("id").collect()
    assert d[2]["name"] == "Unknown_Name" and d[3]["born"] == "Unknown_Born_Place"
    dup = C.duplicate_names(p).collect()
    # Missing names default to Unknown_Name and count as one name, as in the benchmark.
    assert sorted((r["name"], r["id"], r["n_ids"]) for r in dup) == [
        ("Ann Lee", "001", 2), ("Ann Lee", "002", 2), ("Unknown_Name", "003", 2), ("Unknown_Name", "004", 2)]
    summ = {(r["attribute"], r["value"]): r["n"] for r in C.attribute_summary(p).collect()}
    assert summ[("employment", "Doctor")] == 2 and summ[("employment", "Unknown_Employment")] == 2
    out = os.path.join(tmp_dir, "stats")
    S.write_profile_stats(RP.profile_stats(p), out)
    back = spark.read.json(out)
    assert back.where("section = 'duplicated_names'").count() == 4


def test_upsert_by_file_name(spark, tmp_dir):
    """The person is the file's stem, also without an ID inside."""
    qa, persons = os.path.join(tmp_dir, "qa2"), os.path.join(tmp_dir, "p2")
    for i in range(1, 5):
        _write(qa, f"{i:03d}_qa.json", {"Directory": "d", "metadata": [{"Additional_ID": f"{i:03d}"}] if i == 2 else []})
        _write(persons, f"{i:03d}.json", {"question": f"q{i}", "answer": f"a{i}"})
    _write(qa, "notes.json", {"Directory": "d", "metadata": []})
    up = C.upsert_additional_qa(C.with_person(S.read_training_profiles(spark, qa), "_qa"),
                                C.with_person(S.read_persons(spark, persons)), "person", "person")
    got = {r["file_name"]: [(e["Additional_ID"], e["Additional_question"]) for e in r["metadata"]] for r in up.collect()}
    assert got == {**{f"{i:03d}_qa.json": [(f"{i:03d}", f"q{i}")] for i in range(1, 5)}, "notes.json": []}


def test_bulk_questions(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bulk")
    os.makedirs(d)
    with open(os.path.join(d, "part.json"), "w") as f:
        for i in range(3):
            f.write(json.dumps({"ID": f"{i:03d}", "Pure_Text_Questions": [
                {"Question": "Q", "Options": {"A": "x"}, "Correct_Answer": "A"}]}) + "\n")
    assert ES.flatten_mcq(S.read_classification_questions(spark, d, pattern="*.json", lines=True)).count() == 3


def test_image_lists_per_set(spark):
    flat = spark.createDataFrame([("forget", "1"), ("celebrity", "1")], "eval_set string, id string")
    have = spark.createDataFrame([("forget", "1")], "eval_set string, id string")
    assert [r["eval_set"] for r in ES.keep_with_image(flat, have, by_set=True).collect()] == ["forget"]


def test_id_list_roundtrip(spark, tmp_dir):
    path = os.path.join(tmp_dir, "forget_ids.json")
    with open(path, "w") as f:
        json.dump(["093", "010", "100"], f, indent=4)
    rows = S.read_id_list(spark, path).orderBy("idx").collect()
    assert [r["id"] for r in rows] == ["093", "010", "100"]


def test_select_by_prefix_quirk(spark):
    files = spark.createDataFrame([(n,) for n in ["10_questions.json", "100_questions.json", "11_questions.json",
                                                  "10_generation_questions.json"]], "file_name string")
    ids = spark.createDataFrame([("10",)], "id string")
    plain = sorted(r[0] for r in ES.select_by_id_prefix(files, ids, pattern="*_questions.json").collect())
    assert plain == ["100_questions.json", "10_generation_questions.json", "10_questions.json"]
    strict = sorted(r[0] for r in ES.select_by_id_prefix(files, ids, pattern="*_questions.json",
                                                          delimiter="_").collect())
    assert strict == ["10_generation_questions.json", "10_questions.json"]
    plan = ES.select_by_id_prefix(files, ids)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan


def test_image_manifest(spark, tmp_dir):
    d = os.path.join(tmp_dir, "img")
    os.makedirs(d)
    for n in ["001.png", "001.jpg", "002.jpeg", "003.gif", "004.JPG"]:
        with open(os.path.join(d, n), "wb") as f:
            f.write(b"x")  # the listing skips empty files
    m = {r["id"]: os.path.basename(r["image_path"]) for r in C.image_manifest(S.image_listing(spark, d)).collect()}
    assert m == {"001": "001.png", "002": "002.jpeg"}


def test_split_write_load(spark, tmp_dir):
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(1, 101)], "id string")
    split = forget_retain_split(ids, ratios=[5, 10])
    root = os.path.join(tmp_dir, "split")
    S.write_split(split, root)
    forget, retain = S.load_split(spark, root, 10)
    assert forget.count() == 10 and retain.count() == 90
    S.write_split(split.where("ratio = 5").withColumn("id", F.lit("x")), root)  # ignored: exists
    assert S.load_split(spark, root, 5)[0].count() == 5
    with pytest.raises(FileNotFoundError):
        S.load_split(spark, root, 15)
    more = forget_retain_split(ids, ratios=[5, 15], seed=7)
    S.write_split(more, root)  # a later ratio is added, the saved one stays
    assert S.load_split(spark, root, 15)[0].count() == 15
    kept = {r["id"] for r in S.load_split(spark, root, 5)[0].collect()}
    assert kept == {r["id"] for r in split.where("ratio = 5 and set = 'forget'").collect()}
    os.remove(os.path.join(root, "ratio=10", "_SUCCESS"))  # a write that broke off
    with pytest.raises(FileNotFoundError):
        S.load_split(spark, root, 10)
    S.write_split(split, root)
    assert S.load_split(spark, root, 10)[0].count() == 10
    assert S.read_split(spark, root).groupBy("ratio").count().count() == 3
    S.write_id_lists(split, os.path.join(tmp_dir, "lists"))
    txt = spark.read.text(os.path.join(tmp_dir, "lists")).where("ratio = 10 AND set = 'forget'").first()[0]
    assert len(json.loads(txt)) == 10


def test_questions_and_report(spark, tmp_dir):
    d = os.path.join(tmp_dir, "q")
    _write(d, "001_questions.json", {"ID": "001", "Image_Textual_Questions": [
        {"Question": "Who?", "Options": {"B": "x", "A": "y"}, "Correct_Answer": "A"}]})
    _write(d, "002_questions.json", {"ID": "002", "Pure_Text_Questions": [
        {"Question": "What?", "Options": {"A": "1", "B": "2", "C": "3", "D": "4"}, "Correct_Answer": "b"}]})
    q = ES.flatten_mcq(S.read_classification_questions(spark, d))
    rows = q.orderBy("id").collect()
    assert [(r["id"], r["kind"], r["question_idx"]) for r in rows] == [("001", "Image_Textual", 1),
                                                                        ("002", "Pure_Text", 1)]
    keys = q.where("id = '001'").select(F.map_keys("Options")).first()[0]
    assert keys == ["B", "A"]  # stored order kept
    prompts = ES.classification_prompts(q, "celebrity", "llava-x").orderBy("id").collect()
    assert prompts[0]["prompt"].startswith("USER: <image>\nWho?\nB: x\nA: y\n")
    g = os.path.join(tmp_dir, "g")
    _write(g, "001_generation_questions.json", {"ID": "001", "Generation_Questions": [
        {"Type": "Image_Textual", "Question": "Q", "Ground_Truth": "the cat sat"},
        {"Type": "Other", "Question": "Q2", "Ground_Truth": "a b"}]})
    gen = ES.flatten_generation(S.read_generation_questions(spark, g))
    assert gen.count() == 2


def test_empty_eval_set_reports_zero(spark):
    mcq = spark.createDataFrame([], "eval_set string, kind string, correct int")
    gen = spark.createDataFrame([], "eval_set string, Type string, bleu double, rouge1 double, rouge2 double, "
                                    "rougeL double")
    rep = RP.eval_report(mcq, gen).collect()
    assert len(rep) == 4 * (2 + 8) and all(r["value"] == 0.0 for r in rep)
    doc = json.loads(RP.report_document(RP.eval_report(mcq, gen)).first()[0])
    assert list(doc) == list(RP.REPORT_SETS)


def test_write_profiles_and_generation_results(spark, qa_folder, tmp_dir):
    p = C.propagate_id(S.read_training_profiles(spark, qa_folder)).drop("file_name")
    out = os.path.join(tmp_dir, "curated")
    S.write_profiles(p, out)
    back = spark.read.schema(p.schema).json(out)
    assert back.count() == 3
    res = spark.createDataFrame([("forget", "001", "Image_Textual", "Q", "the cat", "a cat"),
                                 ("test", "002", "Pure_Text", "Q2", "x", "y")],
                                "eval_set string, id string, Type string, Question string, response string, "
                                "Ground_Truth string")
    g = os.path.join(tmp_dir, "gen")
    S.write_generation_results(res, g)
    rows = spark.read.json(g).where("eval_set = 'forget'").collect()
    assert rows[0]["image_id"] == "001" and rows[0]["question type"] == "Image_Textual"
    assert rows[0]["generated_answer"] == "the cat"


def test_id_lists_in_chunks(spark, tmp_dir):
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(1, 501)], "id string")
    split = forget_retain_split(ids, ratios=[10])
    root = os.path.join(tmp_dir, "chunked")
    S.write_id_lists(split, root, ids_per_file=100)
    back = S.read_id_list(spark, os.path.join(root, "ratio=10", "set=retain"))
    assert back.select("file_name").distinct().count() > 1
    got = {r["id"] for r in back.collect()}
    want = {r["id"] for r in split.where("set = 'retain'").collect()}
    assert got == want and len(got) == 450


BAD = {"cut.json": ('{"ID": "001", "Directory": "d", "meta', "malformed"), "more.json": ('{"ID": "1"} {"ID": "2"}', "malformed"),
       "tail.json": ('{"ID": "1"} x', "malformed"), "quotes.json": ("{'ID': '1'}", "malformed"), "none.json": ("", "empty"),
       "blank.json": (" \n ", "empty"), "list.json": ('[{"ID": "1"}]', "schema"), "null.json": ("null", "schema"),
       "typed.json": ('{"ID": "1", "metadata": "x"}', "schema"), "element.json": ('{"ID": "1", "metadata": [5]}', "schema"),
       "bracket.json": ('{"ID": "1"}]}', "malformed"), "brace.json": ('{"ID": "1"}} [', "malformed")}


def test_bad_documents_are_named_or_kept_apart(spark, qa_folder, tmp_dir):
    """A file of no bytes is one of them, although Spark's scans skip it."""
    for name, (raw, _) in BAD.items():
        with open(os.path.join(qa_folder, name), "w") as f:
            f.write(raw)
        with pytest.raises(Exception, match=name):
            S.read_training_profiles(spark, qa_folder, pattern=name).count()
    kept_apart = os.path.join(tmp_dir, "quarantine")
    good = S.read_training_profiles(spark, qa_folder, quarantine=kept_apart)
    assert sorted(r["file_name"] for r in good.collect()) == ["001_qa.json", "002_qa.json", "003_qa.json"]
    bad = {r["file_name"]: (r["raw"], r["problem"]) for r in S.read_quarantine(spark, kept_apart).where("position = 1").collect()}
    assert bad == BAD


def test_good_documents_of_odd_shape(spark, tmp_dir):
    """Not a problem: absent and unknown keys, nulls, scalars of another type, repeated keys, pretty printing."""
    d = os.path.join(tmp_dir, "odd")
    os.makedirs(d)
    for i, raw in enumerate(['{}', '{"ID": null}', '{"ID": 5, "Extra": {"a": [1]}}', '{"ID": "1", "ID": "2"}',
                             '{\n  "ID": "3",\n  "metadata": [\n    null\n  ]\n}\n']):
        with open(os.path.join(d, f"{i}.json"), "w") as f:
            f.write(raw)
    got = [r["ID"] for r in S.read_training_profiles(spark, d).orderBy("file_name").collect()]
    assert got == [None, None, "5", "2", "3"]


@pytest.mark.parametrize("split", [128 << 20, 200])
def test_line_numbers_of_bad_lines(spark, tmp_dir, split):
    """Also where a file is read in many blocks; blank lines count as lines, not as documents."""
    d, kept_apart = os.path.join(tmp_dir, "lines"), os.path.join(tmp_dir, "q")
    os.makedirs(d)
    want = []
    for name in ("a.json", "b.json"):
        lines = []
        for i in range(1, 300):
            raw = json.dumps({"ID": f"{i:03d}", "Directory": "d" * (i % 40), "metadata": []})
            if i % 37 == 5:
                raw = raw[:9]
                want.append((name, i, "malformed", raw))
            lines.append("" if i % 41 == 3 else raw)
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    want = [w for w in want if w[1] % 41 != 3]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        good = S.read_training_profiles(spark, d, lines=True, quarantine=kept_apart).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [tuple(r) for r in S.read_quarantine(spark, kept_apart).select("file_name", "position", "problem", "raw").collect()]
    assert sorted(got) == sorted(want)
    assert good == 2 * sum(1 for i in range(1, 300) if i % 37 != 5 and i % 41 != 3)


def test_null_and_repeated_ids_in_lists(spark, tmp_dir):
    rows = [(None, 10, "forget")] * 300 + [("007", 10, "forget")] * 200 + [(f"{i:03d}", 10, "retain") for i in range(50)]
    root = os.path.join(tmp_dir, "null-lists")
    S.write_id_lists(spark.createDataFrame(rows, "id string, ratio int, `set` string"), root, ids_per_file=40)
    back = S.read_id_list(spark, os.path.join(root, "ratio=10", "set=forget"))
    assert sorted(str(r["id"]) for r in back.collect()) == sorted(["None"] * 300 + ["007"] * 200)
    assert back.groupBy("file_name").count().agg(F.max("count")).first()[0] < 300


def test_empty_images_are_listed(spark, tmp_dir):
    d = os.path.join(tmp_dir, "img0")
    os.makedirs(os.path.join(d, "folder.png"))
    for n, raw in (("001.png", b""), ("002 é.jpg", b"xy"), ("_x.png", b"1"), (".y.png", b"1")):
        with open(os.path.join(d, n), "wb") as f:
            f.write(raw)
    got = {os.path.basename(r["path"]): r["length"] for r in S.image_listing(spark, d).collect()}
    assert got == {"001.png": 0, "002 é.jpg": 2}
    with pytest.raises(FileNotFoundError):
        S.image_listing(spark, os.path.join(tmp_dir, "no-such"))


def test_overwrite_keeps_a_version_readable(spark, tmp_dir):
    """At every step readers see one whole version; what a broken write left goes with the next."""
    from lethe.sources import versions as V
    path = os.path.join(tmp_dir, "versions")
    frame = lambda v, n: spark.createDataFrame([(f"{v}{i}", "s" + str(i % 2), i) for i in range(n)], "id string, section string, n long")
    read = lambda: sorted(r["id"] for r in S.read_log(spark, path, "id string, section string, n long").collect())
    S.write_profile_stats(frame("a", 5), path)
    assert read() == [f"a{i}" for i in range(5)]
    files = V.write_beside(frame("b", 7), path, "json", ["section"])
    assert read() == [f"a{i}" for i in range(5)] and len(files) >= 2
    S.write_profile_stats(frame("c", 3), path)
    assert read() == ["c0", "c1", "c2"]
    # The files of both earlier versions are gone, so a plain scan agrees.
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == ["c0", "c1", "c2"]
    assert len([n for n in os.listdir(path) if n.startswith("_manifest")]) == 1
    S.write_profiles(frame("d", 0), os.path.join(tmp_dir, "none"))
    assert spark.read.schema("id string").json(os.path.join(tmp_dir, "none")).count() == 0
