"""Declared schemas of every input and output table (never inferred).

Ids are zero-padded strings ("093"); optional keys of the JSON documents are
nullable fields, so an element that lacks a key reads as NULL.
"""

from pyspark.sql import types as T

S = T.StringType()

BIOGRAPHY = T.StructType([
    T.StructField("Name", S), T.StructField("Employment", S), T.StructField("Born", S),
])

# One NNN.json per person.
PROFILE = T.StructType([
    T.StructField("ID", S),
    T.StructField("biography", BIOGRAPHY),
    T.StructField("question", S),
    T.StructField("answer", S),
])

QA_ELEMENT = T.StructType([
    T.StructField("ID", S), T.StructField("Question", S), T.StructField("Answer", S),
    T.StructField("Additional_ID", S), T.StructField("Additional_question", S),
    T.StructField("Additional_answer", S),
])

# One NNN_qa.json per person.
TRAINING_PROFILE = T.StructType([
    T.StructField("ID", S),
    T.StructField("Directory", S),
    T.StructField("metadata", T.ArrayType(QA_ELEMENT)),
])

MCQ = T.StructType([
    T.StructField("Question", S),
    T.StructField("Options", T.MapType(S, S)),
    T.StructField("Correct_Answer", S),
])

# One NNN_questions.json per person.
CLASSIFICATION_QUESTIONS = T.StructType([
    T.StructField("ID", S),
    T.StructField("Image_Textual_Questions", T.ArrayType(MCQ)),
    T.StructField("Pure_Text_Questions", T.ArrayType(MCQ)),
])

GEN_QUESTION = T.StructType([
    T.StructField("Type", S), T.StructField("Question", S), T.StructField("Ground_Truth", S),
])

# One NNN_generation_questions.json per person.
GENERATION_QUESTIONS = T.StructType([
    T.StructField("ID", S),
    T.StructField("Generation_Questions", T.ArrayType(GEN_QUESTION)),
])

# Tables that stand in for the model (written by the training/generation side).
PREDICTIONS = "eval_set STRING, id STRING, kind STRING, question_idx INT, generated_text STRING"
STEP_LOG = "run STRING, epoch INT, `set` STRING, step BIGINT, loss DOUBLE, accum INT"
EXAMPLE_LOSSES = "example_id STRING, batch_id BIGINT, loss DOUBLE"
TOKEN_LOSSES = ("example_id STRING, input_ids ARRAY<INT>, labels ARRAY<INT>, "
                "position_loss ARRAY<DOUBLE>")
LOGITS = "batch_id BIGINT, example_id STRING, pos INT, logits ARRAY<DOUBLE>"

GENERATION_RESULT = T.StructType([
    T.StructField("image_id", S), T.StructField("question type", S),
    T.StructField("question", S), T.StructField("generated_answer", S),
    T.StructField("ground_truth", S),
])
