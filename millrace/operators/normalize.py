"""Bringing records of many shapes to one: chat turns, question/answer, multiple choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.hashing import seeded_int, seeded_md5
from millrace.functions.text import strip
from millrace.operators.prefix import dense_position

# Roles of foreign chat records and ours.
ROLE_MAP = {"human": "user", "gpt": "assistant", "system": "system"}

# How a multiple-choice record is asked and answered.
CHOICE_LAYOUT = "Question: {question}\nA. {option_a}\nB. {option_b}\nC. {option_c}\nD. {option_d}"
CHOICE_TEMPLATES = [
    ("Given the following question and four candidate answers (A, B, C, and D), select the most appropriate answer.\n", "The most appropriate answer is {answer}."),
    ("Choose the correct answer from the options below (A, B, C, or D):\n", "The correct answer is {answer}."),
    ("Based on the following question and options, identify the best answer (A, B, C, or D).\n", "The best answer is {answer}."),
    ("Analyze the question and the four answer choices (A, B, C, and D). Then select the correct answer.\n", "After analysis, the correct answer is {answer}."),
    ("Consider the question below and choose the best option from A, B, C, or D.\n", "The best option is {answer}."),
    ("Select the correct response (A, B, C, or D) to the question provided below.\n", "The correct response is {answer}."),
    ("Determine the correct choice (A, B, C, or D) based on the question and information provided.\n", "The determined correct choice is {answer}."),
    ("From the following question and answer choices, identify the correct option (A, B, C, or D).\n", "The identified correct option is {answer}."),
    ("Using the given question and four possible answers, select the best option (A, B, C, or D).\n", "The selected best option is {answer}."),
    ("Read the question and options below, then determine the correct answer (A, B, C, or D).\n", "The determined correct answer is {answer}."),
    ("", "{answer}."),
]


def remap_role(role: Column, mapping: Mapping[str, str] = ROLE_MAP) -> Column:
    """The mapped role; a role the map does not know stops the job."""
    out = F.when(F.lit(False), F.lit(""))
    for old, new in mapping.items():
        out = out.when(role == old, F.lit(new))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("NULL")))).cast("string"))


def remap_roles(df: DataFrame, messages: str = "conversations", mapping: Mapping[str, str] = ROLE_MAP) -> DataFrame:
    """[{from, value}] to [{role, content}]."""
    turned = F.transform(
        messages, lambda m: F.struct(remap_role(m["from"], mapping).alias("role"), m["value"].alias("content"))
    )
    return df.withColumn("messages", turned).drop(messages)


def qa_to_messages(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """A question and its answer as a two-turn record."""
    def turn(role: str, col: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(col).alias("content"))

    return df.withColumn("messages", F.array(turn("user", question), turn("assistant", answer))).drop(question, answer)


def cut_at_delimiter(text: Column, delimiter: str = "\n####") -> Column:
    """Everything before the first delimiter."""
    return F.substring_index(text, delimiter, 1)


def shuffled_choices(choices: Column, seed: int, key: Column) -> Column:
    """The options in seeded order."""
    keyed = F.transform(choices, lambda c, i: F.struct(seeded_md5(seed, key, i).alias("h"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def mc_to_chat(df: DataFrame, seed: int, key: str, question: str, choices: str, answer: str) -> DataFrame:
    """A four-way question as a chat record with a randomly chosen wording.

    The answer letter belongs to the first shuffled option equal to the right text.
    """
    k = F.col(key)
    right = F.element_at(F.col(choices), (F.col(answer) + 1).cast("int"))
    options = df.withColumn("__right", right).withColumn("__opts", shuffled_choices(F.col(choices), seed, k))
    letter = F.substring(F.lit("ABCD"), F.array_position("__opts", F.col("__right")).cast("int"), F.lit(1))
    pick = (seeded_int(seed, F.lit("wording"), k) % len(CHOICE_TEMPLATES)).cast("int") + 1
    intro = F.element_at(F.array(*[F.lit(t[0]) for t in CHOICE_TEMPLATES]), pick)
    reply = F.element_at(F.array(*[F.lit(t[1]) for t in CHOICE_TEMPLATES]), pick)
    body = fill(CHOICE_LAYOUT, {
        "question": F.col(question),
        **{f"option_{x}": F.element_at("__opts", i + 1) for i, x in enumerate("abcd")},
    })
    before = F.substring_index(reply, "{answer}", 1)
    after = F.substring_index(reply, "{answer}", -1)
    return (
        options.withColumn("question_text", F.concat(intro, body))
        .withColumn("answer_text", F.concat(before, letter, after))
        .drop("__right", "__opts")
    )


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Fill {name} slots of a literal template; inserted text is never scanned again."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def assign_ids(df: DataFrame, dataset: str, key: str, separator: str = "_") -> DataFrame:
    """Ids "<dataset><separator><i>", dense and in the order of a unique integer key."""
    placed = dense_position(df, key, out="__i")
    return placed.withColumn("id", F.concat(F.lit(dataset + separator), F.col("__i").cast("string"))).drop("__i")


def messages_to_text(messages: Column) -> Column:
    """Stripped contents of an array of messages, a newline after each, roles dropped."""
    return F.array_join(F.transform(messages, lambda m: F.concat(strip(m["content"]), F.lit("\n"))), "")


def join_turns(turns: DataFrame, piece: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, text): the pieces of a conversation's turns, joined in order; one row each."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("piece"))))
    return turns.groupBy(key).agg(F.array_join(ordered["piece"], "").alias("text"))


def turns_to_text(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The same as ``messages_to_text`` for turns in long form."""
    return join_turns(turns, F.concat(strip(F.col(text)), F.lit("\n")), key, order)


def passthrough_messages(turns: DataFrame, dataset: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns as they are, tagged with the dataset, a dense conversation id and a dense place."""
    ids = assign_ids(turns.select(key).distinct(), dataset, key)
    placed = dense_position(turns, order, by=[key], out="pos")
    return placed.join(ids, key).withColumn("dataset", F.lit(dataset))


def prune_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only the output columns; the scan reads nothing else."""
    return df.select(*keep)
