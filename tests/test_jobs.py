"""The three jobs end to end on small fixture folders."""

import json
import os

from pyspark.sql import functions as F

from lethe import jobs
from lethe import sources as S
from lethe.operators.curate import image_manifest


def _write(folder, name, obj):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)


def _fixture(root, n=40):
    qa, persons, images, questions, gen = (os.path.join(root, x) for x in
                                            ("qa", "persons", "images", "questions", "gen"))
    os.makedirs(images)
    for i in range(1, n + 1):
        pid = f"{i:03d}"
        _write(qa, f"{pid}_qa.json", {"ID": pid, "Directory": f"imgs/{pid}.png", "metadata": [
            {"ID": f"{pid}_{k}", "Question": f"What does this person do {k}?", "Answer": f"Work {k} of {pid}"}
            for k in range(3)]})
        _write(persons, f"{pid}.json", {"ID": pid, "biography": {"Name": f"P{i % 7}"},
                                         "question": f"Extra {pid}?", "answer": f"Yes {pid}"})
        if i % 9 != 0:
            with open(os.path.join(images, f"{pid}.png"), "wb") as f:
                f.write(b"png")
        _write(questions, f"{pid}_questions.json", {"ID": pid,
               "Image_Textual_Questions": [{"Question": f"Q{pid}", "Options": {"A": "a", "B": "b", "C": "c", "D": "d"},
                                            "Correct_Answer": "A"}],
               "Pure_Text_Questions": [{"Question": f"T{pid}", "Options": {"A": "a", "B": "b", "C": "c", "D": "d"},
                                        "Correct_Answer": "B"}]})
        _write(gen, f"{pid}_generation_questions.json", {"ID": pid, "Generation_Questions": [
            {"Type": "Image_Textual", "Question": "Who?", "Ground_Truth": f"the person {pid} works here"},
            {"Type": "Pure_Text", "Question": "Where?", "Ground_Truth": f"in the city of {pid}"}]})
    return qa, persons, images, questions, gen


def test_jobs_end_to_end(spark, tmp_dir):
    qa, persons, images, questions, gen = _fixture(tmp_dir)
    out = os.path.join(tmp_dir, "out")
    sizes = {(r["ratio"], r["set"]): (r["n_profiles"], r["n_rows"])
             for r in jobs.curate_and_split(spark, qa, persons, images, out, ratios=[10]).collect()}
    # 40 persons, 4 without an image -> 36; 10 % -> 3 forget
    assert sizes[(10, "forget")] == (3, 12) and sizes[(10, "retain")] == (33, 132)
    batches = jobs.training_batches(spark, os.path.join(out, "profiles"), images, os.path.join(out, "split"), 10,
                                    batch_size=4, epochs=[0, 1])
    rows = batches.collect()
    assert len(rows) == 2 * 3 * 3  # 3 persons x 3 QA (the upserted element has no Question) x 2 epochs
    for r in rows:
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"])
    lists = os.path.join(out, "id_lists", "ratio=10")
    prompts = jobs.eval_prompts(spark, os.path.join(lists, "set=forget"), os.path.join(lists, "set=retain"),
                                questions, questions, questions, "llava-hf/llava-1.5-7b-hf")
    counts = {r["eval_set"]: r["count"] for r in prompts.groupBy("eval_set").count().collect()}
    assert counts["forget"] == 6 and counts["test"] == 6 and counts["retain_shared"] == 2 * (33 - 2)
    assert counts["retain_celebrity"] == 80
    few = prompts.where("eval_set = 'forget' AND kind = 'Image_Textual'").first()["prompt"]
    assert few.count("Correct Answer: ") == 2 and few.endswith("directly.\nASSISTANT:")
    # the model answers: right on forget/test, wrong elsewhere
    preds = prompts.select("eval_set", "id", "kind", "question_idx", F.when(
        F.col("eval_set").isin("forget", "test"), F.concat(F.lit("ASSISTANT: "), F.col("Correct_Answer")))
        .otherwise(F.lit("ASSISTANT: E")).alias("generated_text"))
    g = jobs.eval_generation_prompts(spark, os.path.join(lists, "set=forget"), os.path.join(lists, "set=retain"),
                                     gen, gen, gen, "llava-hf/llava-1.5-7b-hf")
    gcounts = {r["eval_set"]: r["count"] for r in g.groupBy("eval_set").count().collect()}
    assert gcounts == {"forget": 6, "test": 6, "retain_shared": 66, "retain_celebrity": 80}
    assert g.where("Type = 'Image_Textual'").first()["prompt"].startswith("USER: <image>\nWho?\n")
    gp = g.select("eval_set", "id", "question_idx", F.when(
        F.col("eval_set").isin("forget", "retain_shared", "retain_celebrity"),
        F.concat(F.lit("ASSISTANT: "), F.col("Ground_Truth"))).otherwise(F.lit("nothing")).alias("generated_text"))
    imgs = image_manifest(S.image_listing(spark, images)).select("id")
    results = os.path.join(out, "generation_results")
    rep = {(r["eval_set"], r["metric"]): r["value"]
           for r in jobs.score_predictions(prompts, preds, g, gp, image_ids=imgs,
                                           generation_results=results).collect()}
    written = spark.read.json(results).where("eval_set = 'forget'").first()
    assert written["generated_answer"] == written["ground_truth"]
    assert rep[("Forget Set Results", "Image-Textual Question Accuracy")] == 100.0
    assert rep[("Retain Set (shared dataset) Results", "Pure Text Question Accuracy")] == 0.0
    assert rep[("Forget Set Results", "Average BLEU (Image_Textual)")] == 1.0
    assert rep[("Test Set Results", "Average BLEU (Pure_Text)")] == 0.0
    jobs.write_report(jobs.score_predictions(prompts, preds, g, gp), os.path.join(out, "report"))
    doc = json.loads(spark.read.text(os.path.join(out, "report")).first()[0])
    assert set(doc) == {"Forget Set Results", "Test Set Results", "Retain Set (shared dataset) Results",
                        "Retain Set (real person) Results"}


def test_generation_prompts_of_the_bulk_form(spark, tmp_dir):
    """Many persons a file: chosen by the ID inside, not by the file's name."""
    gen, lists = os.path.join(tmp_dir, "gen-bulk"), os.path.join(tmp_dir, "bulk-lists")
    os.makedirs(gen)
    with open(os.path.join(gen, "part.json"), "w") as f:
        for i in range(1, 9):
            f.write(json.dumps({"ID": f"{i:03d}", "Generation_Questions": [
                {"Type": "Image_Textual", "Question": f"Who is {i}?", "Ground_Truth": "a"}]}) + "\n")
    for name, ids in (("forget.json", ["001", "002"]), ("retain.json", ["003", "004", "005"])):
        _write(lists, name, ids)
    out = jobs.eval_generation_prompts(spark, os.path.join(lists, "forget.json"), os.path.join(lists, "retain.json"),
                                       gen, gen, gen, "llava-hf/llava-1.5-7b-hf", lines=True)
    counts = {r["eval_set"]: r["count"] for r in out.groupBy("eval_set").count().collect()}
    assert counts == {"forget": 2, "test": 2, "retain_shared": 3, "retain_celebrity": 8}


def test_profiles_of_one_id_keep_their_rows(spark, tmp_dir):
    """Two profiles share an ID: each question is a batch row of its own in every epoch."""
    qa, images, out = (os.path.join(tmp_dir, x) for x in ("qa-same", "img-same", "split-same"))
    os.makedirs(images)
    os.makedirs(qa)
    for n in ("a.png", "b.png"):
        with open(os.path.join(images, n), "wb") as f:
            f.write(b"x")
    with open(os.path.join(qa, "p.json"), "w") as f:
        for n, answer in (("a.png", "a b c"), ("b.png", "d e")):
            f.write(json.dumps({"ID": "001", "Directory": f"x/{n}", "metadata": [
                {"ID": "001_1", "Question": "Q one?", "Answer": answer}, {"ID": "001_2", "Question": "Q two?", "Answer": answer}]}) + "\n")
    split = spark.createDataFrame([("001", 10, "forget"), ("002", 10, "retain")], "id string, ratio int, `set` string")
    S.write_split(split, out)
    rows = jobs.training_batches(spark, qa, images, out, 10, batch_size=3, epochs=range(5)).collect()
    assert len(rows) == 4 * 5
    for e in range(5):
        mine = sorted((r["batch_id"], r["slot"]) for r in rows if r["epoch"] == e)
        assert mine == [(0, 0), (0, 1), (0, 2), (1, 0)]
        assert sorted(os.path.basename(r["image_path"]) for r in rows if r["epoch"] == e) == ["a.png", "a.png", "b.png", "b.png"]
