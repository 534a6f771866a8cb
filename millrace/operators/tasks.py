"""Evaluation tasks: how a record becomes a context, continuations, a label and a conditional.

A task is a projection. Every builder takes a function from field name to column and returns
the four parts; nothing here touches rows, so a task costs no more than a select.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import strip

Fields = Callable[[str], Column]

# Answer keys and the letters that digits stand for.
LETTERS = ("A", "B", "C", "D", "E")
DIGITS = {"1": "A", "2": "B", "3": "C", "4": "D", "5": "E"}

ANSWER = "Answer:"


@dataclass(frozen=True)
class Parts:
    text: Column
    continuations: Column
    label: Column
    conditional: Column


def _led(*texts: Column) -> Column:
    """Continuations carry a leading blank."""
    return F.array(*[F.concat(F.lit(" "), t) for t in texts])


def _led_all(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit(" "), t))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _index(of: Column, letters: tuple[str, ...]) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in letters]), of) - 1).cast("int")


def _last_word(text: Column) -> Column:
    """What follows the last blank."""
    return F.substring_index(text, " ", -1)


def capitalize(text: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def clean_brackets(text: Column) -> Column:
    out = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    out = F.regexp_replace(out, r"\[.*?\]", "")
    return F.replace(out, F.lit("  "), F.lit(" "))


def detokenize(text: Column) -> Column:
    """Undo tokenised spacing around contractions, brackets, quotes and marks."""
    # What is replaced by what, in this order.
    for old, new in ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r" (['.,])", "$1")


def piqa(f: Fields) -> Parts:
    return Parts(_join("Question: ", f("goal"), "\nAnswer:"), _led(f("sol1"), f("sol2")), f("label"), F.lit(ANSWER))


def hellaswag(f: Fields) -> Parts:
    tail = capitalize(f("ctx_b"))
    cond = clean_brackets(tail)
    return Parts(
        clean_brackets(_join(f("activity_label"), ": ", f("ctx_a"), " ", tail)),
        F.transform(f("endings"), lambda e: F.concat(F.lit(" "), clean_brackets(e))),
        f("label").cast("int"),
        F.when(F.length(cond) == 0, _last_word(clean_brackets(f("ctx_a")))).otherwise(cond),
    )


def openbook_qa(f: Fields) -> Parts:
    stem = f("question_stem")
    key = _index(strip(f("answerKey")), LETTERS[:4])
    return Parts(stem, _led_all(f("choices")), key, _last_word(strip(stem)))


def boolq(f: Fields) -> Parts:
    text = _join(f("passage"), "\nQuestion: ", f("question"), "?\nAnswer:")
    label = F.when(f("answer"), 0).otherwise(1)
    return Parts(text, _led(F.lit("yes"), F.lit("no")), label, F.lit(ANSWER))


def sciq(f: Fields) -> Parts:
    text = _join(strip(f("support")), "\nQuestion: ", f("question"), "\nAnswer:")
    options = _led(f("distractor1"), f("distractor2"), f("distractor3"), f("correct_answer"))
    return Parts(text, options, F.lit(3), F.lit(ANSWER))


def _arc_key(f: Fields) -> Column:
    key = f("answerKey")
    letter = F.when(F.lit(False), F.lit(""))
    for digit, mapped in DIGITS.items():
        letter = letter.when(key == digit, F.lit(mapped))
    return _index(letter.otherwise(key), LETTERS)


def arc(f: Fields) -> Parts:
    text = _join("Question: ", f("question"), "\nAnswer:")
    return Parts(text, _led_all(f("choices")), _arc_key(f), F.lit(ANSWER))


def arc_answer_only(f: Fields) -> Parts:
    base = arc(f)
    right = F.element_at(f("choices"), _arc_key(f) + 1)
    return Parts(base.text, _led(right), F.lit(0), base.conditional)


def social_iqa(f: Fields) -> Parts:
    text = _join("Question: ", f("context"), " ", f("question"), "\nAnswer:")
    return Parts(text, _led(f("answerA"), f("answerB"), f("answerC")), f("label").cast("int") - 1, F.lit(ANSWER))


def copa(f: Fields) -> Parts:
    connector = F.when(f("question") == "cause", "because").otherwise("therefore")
    premise = strip(f("premise"))
    short = F.substring(premise, F.lit(1), F.greatest(F.length(premise) - 1, F.lit(0)))

    def lowered(choice: Column) -> Column:
        return F.concat(F.lower(F.substring(choice, 1, 1)), F.substring(choice, 2, 2**31 - 1))

    return Parts(_join(short, " ", connector), _led(lowered(f("choice1")), lowered(f("choice2"))), f("label"), connector)


def rte(f: Fields) -> Parts:
    text = _join(f("sentence1"), "\nQuestion: ", f("sentence2"), " True or False?\nAnswer:")
    return Parts(text, _led(F.lit("True"), F.lit("False")), f("label"), F.lit(ANSWER))


def commitment_bank(f: Fields) -> Parts:
    text = _join(f("premise"), "\nQuestion: ", f("hypothesis"), ". True, False or Neither?\nAnswer:")
    return Parts(text, _led(F.lit("True"), F.lit("False"), F.lit("Neither")), f("label"), F.lit(ANSWER))


def mrpc(f: Fields) -> Parts:
    text = _join(
        "Sentence 1: ", detokenize(f("sentence1")), "\nSentence 2: ", detokenize(f("sentence2")),
        "\nQuestion: Do both sentences mean the same thing?\nAnswer:",
    )
    label = F.when(f("label").cast("boolean"), 0).otherwise(1)
    return Parts(text, _led(F.lit("yes"), F.lit("no")), label, F.lit(ANSWER))


def sst2(f: Fields) -> Parts:
    text = _join(detokenize(f("sentence")), "\nQuestion: Is this sentence positive or negative?\nAnswer:")
    return Parts(text, _led(F.lit("negative"), F.lit("positive")), f("label"), F.lit(ANSWER))


def multi_subject_example(question: Column, choices: Column, lettered: bool) -> Column:
    """Question, lettered options if wanted, and the open answer line."""
    if not lettered:
        return _join("Question: ", strip(question), "\n", ANSWER)
    options = F.array_join(
        F.transform(
            choices,
            lambda c, i: F.concat(F.element_at(F.array(*[F.lit(x) for x in LETTERS[:4]]), i + 1), F.lit(". "), c, F.lit("\n")),
        ),
        "",
    )
    return _join(strip(question), "\n", options, ANSWER)


def multi_subject(f: Fields, lettered: bool = False) -> Parts:
    options = _led(*[F.lit(x) for x in LETTERS[:4]]) if lettered else _led_all(f("choices"))
    return Parts(multi_subject_example(f("question"), f("choices"), lettered), options, f("answer"), F.lit(ANSWER))


def question_value(f: Fields) -> Parts:
    return Parts(_join("\nQuestion: ", f("question"), "\nAnswer:"), _led(f("answer")["value"]), F.lit(0), F.lit(ANSWER))


def question_first(f: Fields) -> Parts:
    first = F.element_at(f("answer"), 1)
    return Parts(_join("\nQuestion: ", f("question"), "\nAnswer:"), _led(first), F.lit(0), F.lit(ANSWER))


@dataclass(frozen=True)
class Task:
    build: Callable[..., Parts] | None
    metric: str
    options: Mapping[str, object] = field(default_factory=dict)


# Registered task names with their metric. The pair-context task (winogrande)
# has its own request shape and no builder here.
TASKS: dict[str, Task] = {
    "piqa": Task(piqa, "len_norm"),
    "hellaswag": Task(hellaswag, "len_norm"),
    "winogrande": Task(None, "acc"),
    "openbook_qa": Task(openbook_qa, "len_norm"),
    "boolq": Task(boolq, "acc"),
    "sciq": Task(sciq, "acc"),
    "arc_easy": Task(arc, "acc"),
    "arc_easy_ppl": Task(arc_answer_only, "ce_loss"),
    "arc_challenge": Task(arc, "len_norm"),
    "basic_arithmetic": Task(arc, "acc"),
    "copa": Task(copa, "acc"),
    "rte": Task(rte, "len_norm"),
    "commitment_bank": Task(commitment_bank, "acc"),
    "mrpc": Task(mrpc, "f1"),
    "sst2": Task(sst2, "acc"),
    "commonsense_qa": Task(arc, "len_norm"),
    "social_iqa": Task(social_iqa, "len_norm"),
    "trivia_qa_wiki_ppl": Task(question_value, "ce_loss"),
    "natural_qs_open_ppl": Task(question_first, "ce_loss"),
}
for _category in ("stem", "humanities", "social_sciences", "other"):
    for _suffix, _options in (
        ("", {"split": "validation"}),
        ("_test", {"split": "test"}),
        ("_var", {"split": "validation", "variants": 1}),
        ("_mc_5shot", {"split": "validation", "variants": 2, "lettered": True}),
        ("_mc_5shot_test", {"split": "test", "variants": 2, "lettered": True}),
    ):
        TASKS[f"mmlu_{_category}{_suffix}"] = Task(multi_subject, "len_norm", {"category": _category, **_options})

# Prompt variants by number; None is the bare question.
VARIANTS: dict[int | None, list[str | None]] = {
    None: [None],
    1: [None, "inst", "inst+1", "inst+2", "inst+3", "inst+4", "inst+5"],
    2: ["inst+5"],
}

# Subject to field, and category to its fields in order.
SUBJECT_FIELD: dict[str, str] = {
    "abstract_algebra": "math",
    "anatomy": "health",
    "astronomy": "physics",
    "business_ethics": "business",
    "clinical_knowledge": "health",
    "college_biology": "biology",
    "college_chemistry": "chemistry",
    "college_computer_science": "computer science",
    "college_mathematics": "math",
    "college_medicine": "health",
    "college_physics": "physics",
    "computer_security": "computer science",
    "conceptual_physics": "physics",
    "econometrics": "economics",
    "electrical_engineering": "engineering",
    "elementary_mathematics": "math",
    "formal_logic": "philosophy",
    "global_facts": "other",
    "high_school_biology": "biology",
    "high_school_chemistry": "chemistry",
    "high_school_computer_science": "computer science",
    "high_school_european_history": "history",
    "high_school_geography": "geography",
    "high_school_government_and_politics": "politics",
    "high_school_macroeconomics": "economics",
    "high_school_mathematics": "math",
    "high_school_microeconomics": "economics",
    "high_school_physics": "physics",
    "high_school_psychology": "psychology",
    "high_school_statistics": "math",
    "high_school_us_history": "history",
    "high_school_world_history": "history",
    "human_aging": "health",
    "human_sexuality": "culture",
    "international_law": "law",
    "jurisprudence": "law",
    "logical_fallacies": "philosophy",
    "machine_learning": "computer science",
    "management": "business",
    "marketing": "business",
    "medical_genetics": "health",
    "miscellaneous": "other",
    "moral_disputes": "philosophy",
    "moral_scenarios": "philosophy",
    "nutrition": "health",
    "philosophy": "philosophy",
    "prehistory": "history",
    "professional_accounting": "other",
    "professional_law": "law",
    "professional_medicine": "health",
    "professional_psychology": "psychology",
    "public_relations": "politics",
    "security_studies": "politics",
    "sociology": "culture",
    "us_foreign_policy": "politics",
    "virology": "health",
    "world_religions": "philosophy",
}
CATEGORY_FIELDS: dict[str, list[str]] = {
    "stem": ["physics", "chemistry", "biology", "computer science", "math", "engineering"],
    "humanities": ["history", "philosophy", "law"],
    "social_sciences": ["politics", "culture", "economics", "geography", "psychology"],
    "other": ["other", "business", "health"],
}


def subjects_of(name: str) -> list[str]:
    """Subjects of a category (field by field), of one subject, or of one field."""
    if name in CATEGORY_FIELDS:
        return [s for f in CATEGORY_FIELDS[name] for s, own in SUBJECT_FIELD.items() if own == f]
    if name in SUBJECT_FIELD:
        return [name]
    return [s for s, own in SUBJECT_FIELD.items() if own == name]


def task_prompts(records: DataFrame, task: str, keys: list[str]) -> DataFrame:
    """(keys, ctx_text, continuations, label_id, dc_text) for a task's records."""
    spec = TASKS[task]
    if spec.build is None:
        raise ValueError(f"{task} has several contexts per record; use pair_context_prompts")
    if "variants" in spec.options:
        raise ValueError(f"{task} puts examples in front; use evaluation.subject_task_prompts")
    options = {k: v for k, v in spec.options.items() if k == "lettered"}
    parts = spec.build(lambda name: F.col(name), **options)
    return records.select(
        *keys,
        parts.text.alias("ctx_text"),
        parts.continuations.alias("continuations"),
        parts.label.cast("bigint").alias("label_id"),
        parts.conditional.alias("dc_text"),
    )


def pair_context_prompts(records: DataFrame, keys: list[str]) -> DataFrame:
    """Two contexts, one continuation: the sentence is split at its first underscore."""
    sentence = F.col("sentence")
    at = F.instr(sentence, "_")
    at = F.when(at > 0, at).otherwise(F.raise_error(F.lit("a sentence has no underscore")).cast("int"))
    head = F.substring(sentence, F.lit(1), at - 1)
    tail = F.concat(F.lit(" "), strip(F.substring(sentence, at + 1, F.length(sentence))))
    options = F.array("option1", "option2")
    return records.select(
        *keys,
        F.transform(options, lambda o: F.concat(head, o)).alias("ctx_texts"),
        options.alias("dc_texts"),
        tail.alias("continuation_text"),
        (F.col("answer").cast("int") - 1).cast("bigint").alias("label_id"),
    )
