"""Prompt texts as Column expressions.

The templates are the benchmark's literal strings; the model family is a
prefix of the model id (``HuggingFaceM4/...``, ``llava...``,
``meta-llama/...``) and is known when the query is built, so each
function returns one ``concat`` per family and kind, fully inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model families (model-id prefixes) the benchmark supports.
IDEFICS = "HuggingFaceM4"
LLAVA = "llava"
LLAMA = "meta-llama"
FAMILIES = (IDEFICS, LLAVA, LLAMA)

# Prompt pieces, as the benchmark writes them.
CLS_INSTRUCTION = {
    IDEFICS: "Just give ONE letter representing the answer directly.",
    LLAVA: "Answer with the option's letter from the given choices directly.",
}
LLAMA_CLS_IMAGE_HEAD = ("<|image|><|begin_of_text|> ###Instruction: You are a helpful assistant that "
                        "will answer all following multiple choice questions in letter from A, B, C, D \n"
                        "###Question: ")
LLAMA_CLS_IMAGE_TAIL = "\n###Answer:"
LLAMA_CLS_TEXT_HEAD = "<|begin_of_text|>### Question: "
LLAMA_CLS_TEXT_TAIL = "\nPlease only generate ONE letter representing the answer!\n### Answer:"
GEN_IMAGE_TAIL = ("\nAnswer the question based on your trained knowledge in one sentence accurately "
                  "in ENGLISH!!.\nASSISTANT: ")
GEN_TEXT_TAIL = "\nAnswer the question based on your trained knowledge in one sentence in ENGLISH!!\nASSISTANT:"
EXTRACT_JSON_PROMPT = "USER: <image>\nExtract JSON.\nASSISTANT:"
NAME_SENTENCE = "This person's name is "
ANONYMOUS = "this person"
OPTION_KEYS = ("A", "B", "C", "D")


def family(model_id: str) -> str:
    for f in FAMILIES:
        if model_id.startswith(f):
            return f
    raise ValueError(f"no prompt family for {model_id!r}; known: {', '.join(FAMILIES)}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _s(x) -> Column:
    """A value as Python's f-string shows it (``None`` for a null)."""
    return F.coalesce(_c(x).cast("string"), F.lit("None"))


def options_text(options) -> Column:
    """``A: x\\nB: y`` in the stored order of the map."""
    return F.array_join(F.transform(F.map_entries(_c(options)),
                                    lambda e: F.concat(e["key"], F.lit(": "), _s(e["value"]))), "\n")


def mcq_prompt(question, options, llama: bool = False) -> Column:
    """Question and options; the llama form inserts ``####Choices:``."""
    sep = "\n####Choices:\n" if llama else "\n"
    return F.concat(_s(question), F.lit(sep), options_text(options))


def few_shot_item(question, options, answer, model_id: str, image: bool) -> Column:
    """The text of one exemplar (options by key A-D)."""
    opts = _c(options)
    body = [F.lit("Question: " if family(model_id) != LLAMA else "### Question: "), _s(question), F.lit("\n")]
    if family(model_id) == LLAMA:
        body.append(F.lit("Options:\n"))
    for k in OPTION_KEYS:
        body += [F.lit(f"{k}: "), _s(opts[k]), F.lit("\n")]
    body += [F.lit("Correct Answer: "), _s(answer), F.lit("\n")]
    if family(model_id) == LLAMA:
        head = "<|image|>\n<|begin_of_text|>" if image else "<|begin_of_text|>"
    else:
        head = "USER: <image>\n" if image else "USER:\n"
    return F.concat(F.lit(head), *body)


def classification_prompt(question_with_options, few_shot, model_id: str, image: bool) -> Column:
    """X5, classification: exemplars, the question with its options, the
    family's instruction.  ``question_with_options`` must be the llama
    form (X1) for llama, which also drops the exemplars (as the benchmark
    does)."""
    f = family(model_id)
    q = _c(question_with_options)
    if f == LLAMA:
        if image:
            return F.concat(F.lit(LLAMA_CLS_IMAGE_HEAD), q, F.lit(LLAMA_CLS_IMAGE_TAIL))
        return F.concat(F.lit(LLAMA_CLS_TEXT_HEAD), q, F.lit(LLAMA_CLS_TEXT_TAIL))
    head = "USER: <image>\n" if image else "USER:\n"
    return F.concat(F.coalesce(_c(few_shot), F.lit("")), F.lit(head), q,
                    F.lit("\n" + CLS_INSTRUCTION[f] + "\nASSISTANT:"))


def generation_prompt(question, model_id: str, image: bool) -> Column:
    """X5, generation."""
    q = _s(question)
    if family(model_id) == LLAMA:
        if image:
            return F.concat(F.lit("<|image|><|begin_of_text|>### Question:"), q, F.lit("\n### Answer:"))
        return F.concat(F.lit("<|begin_of_text|>### Question: "), q, F.lit("\n### Answer:"))
    if image:
        return F.concat(F.lit("USER: <image>\n"), q, F.lit(GEN_IMAGE_TAIL))
    return F.concat(F.lit("USER: "), q, F.lit(GEN_TEXT_TAIL))


def extract_json_prompt() -> Column:
    """X5, evaluation of the structured answer: the image alone."""
    return F.lit(EXTRACT_JSON_PROMPT)


def eval_question_prompt(question) -> Column:
    """X5, llava evaluation collate: the question without its answer."""
    return F.concat(F.lit("USER: <image>\n"), _s(question), F.lit("\nASSISTANT:"))


def train_prompt(question, answer, style: str = "llava") -> Column:
    """Training text.  ``llava``: ``USER: <image>\\n{q}\\nASSISTANT: {a}``;
    ``legacy``: the same without the newline after the image tag;
    ``llama``: the llama dialog in one line."""
    q, a = _s(question), _s(answer)
    if style == "llava":
        return F.concat(F.lit("USER: <image>\n"), q, F.lit("\nASSISTANT: "), a)
    if style == "legacy":
        return F.concat(F.lit("USER: <image>"), q, F.lit("\nASSISTANT: "), a)
    if style == "llama":
        return F.concat(F.lit("<|image|><|begin_of_text|>### Question:"), q, F.lit("### Answer:"), a,
                        F.lit("<|end_of_text|>"))
    raise ValueError(f"unknown prompt style: {style}")


def chat_messages(question, answer) -> Column:
    """User (image + text) and assistant (text) messages."""
    none = F.lit(None).cast("string")
    item = lambda t, txt: F.struct(F.lit(t).alias("type"), txt.alias("text"))
    return F.array(
        F.struct(F.lit("user").alias("role"),
                 F.array(item("image", none), item("text", _c(question))).alias("content")),
        F.struct(F.lit("assistant").alias("role"),
                 F.array(item("text", _c(answer))).alias("content")))


def named_prompt(question, answer, name) -> Column:
    """``this person`` replaced by the name; the name sentence is added
    only when the name is ``Unknown``."""
    q = F.replace(_s(question), F.lit(ANONYMOUS), _s(name))
    unknown = _c(name) == F.lit("Unknown")
    return F.when(unknown, F.concat(F.lit("USER: " + NAME_SENTENCE), _s(name), F.lit(".\n"), q,
                                    F.lit("\nASSISTANT: "), _s(answer))) \
        .otherwise(F.concat(F.lit("USER: "), q, F.lit("\nASSISTANT: "), _s(answer)))
