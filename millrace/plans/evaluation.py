"""Queries that build evaluation requests and score what a model returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.hashing import seeded_unit
from millrace.functions.text import words
from millrace.operators import evaluation as E
from millrace.operators import tasks
from millrace.operators.prefix import dense_position
from millrace.plans.chat import _chat_rows
from millrace.plans.corpus import SQL_MC, SQL_QA, _multiple_choice, _questions
from millrace.plans.registry import query, table
from millrace.plans.shared import (
    SEED,
    SQL_CHAT_FIT,
    chat_vocab,
    joined_ids,
    sql_strip,
    sql_unit,
    sql_vocab,
    sql_word_ids,
    sql_words,
)
from millrace.session import stage

CTX = 2048
SHORT_CTX = 24  # where cutting is what is shown
SUBJECTS = sorted(tasks.SUBJECT_FIELD)
K4 = "(SELECT range AS k FROM range(4))"

# --- subject questions from the conversations ------------------------------------------


def _subject_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_key, turn, subject, question, choices, answer): user turns as questions."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    n = items.agg(F.count(F.lit(1))).scalar()
    subject = F.element_at(F.array(*[F.lit(s) for s in SUBJECTS]), (F.col("conv_id") % 57 + 1).cast("int"))
    asked = _questions(spark, sf).select(
        (F.shiftleft("conv_id", 32) + F.col("turn")).alias("doc_key"),
        "turn",
        "question",
        subject.alias("subject"),
        ((F.col("conv_id") + F.col("turn")) % 4).alias("answer"),
    )
    wanted = asked.select("doc_key", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k"))
    wanted = wanted.withColumn("item_id", (F.col("doc_key") + 7 * F.col("k")) % n)
    choices = wanted.join(items, "item_id").groupBy("doc_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("choices")
    )
    return asked.join(choices, "doc_key")


SQL_SUBJECT_DOCS = f"""{SQL_QA}, nb AS (SELECT count(*) AS n FROM benchmark),
mm AS (SELECT conv_id * 4294967296 + turn AS doc_key, turn, question, ({SUBJECTS})[CAST(conv_id % 57 AS INTEGER) + 1] AS subject, (conv_id + turn) % 4 AS answer FROM qa),
mmc AS (SELECT doc_key, list(b.text ORDER BY k) AS choices FROM mm CROSS JOIN {K4} CROSS JOIN nb JOIN benchmark b ON b.item_id = (doc_key + 7 * k) % n GROUP BY doc_key),
md AS (SELECT mm.*, choices FROM mm JOIN mmc USING (doc_key))"""


def sql_example(lettered: bool) -> str:
    q = sql_strip("question")
    if lettered:
        opts = " || ".join(f"'{x}. ' || choices[{i + 1}] || E'\\n'" for i, x in enumerate("ABCD"))
        return f"({q} || E'\\n' || {opts} || 'Answer:')"
    return f"('Question: ' || {q} || E'\\nAnswer:')"


INST = r"""('The following are multiple choice questions (with answers) about ' || replace(subject, '_', ' ') || E':\n\n')"""


def sql_shots(lettered: bool) -> str:
    told = "substr('ABCD', CAST(answer AS INTEGER) + 1, 1)" if lettered else "choices[CAST(answer AS INTEGER) + 1]"
    return f"""dev AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY doc_key) AS rn,
  {sql_example(lettered)} || ' ' || {told} || E'\\n\\n' AS shown FROM md WHERE turn <= 1)"""


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dev, test): the first exchange of a conversation, and the later ones."""
    return docs.where("turn <= 1"), docs.where("turn > 1")


@query("fewshot_join", f"""WITH {SQL_SUBJECT_DOCS}, {sql_shots(True)},
pre AS (SELECT subject, string_agg(shown, '' ORDER BY rn) AS prefix FROM dev WHERE rn <= 5 GROUP BY subject)
SELECT doc_key, subject, {INST} || coalesce(prefix, '') || {sql_example(True)} AS ctx_text FROM md LEFT JOIN pre USING (subject) WHERE turn > 1""")
def fewshot_join(spark, sf):
    dev, test = _split(_subject_docs(spark, sf))
    return E.fewshot_join(test, dev).select("doc_key", "subject", "ctx_text")


@query("prompt_variants", f"""WITH {SQL_SUBJECT_DOCS}, {sql_shots(False)},
v AS (SELECT * FROM (VALUES (0, 'plain', 0, 0), (1, 'inst', 1, 0), (2, 'inst+1', 1, 1), (3, 'inst+2', 1, 2), (4, 'inst+3', 1, 3), (5, 'inst+4', 1, 4), (6, 'inst+5', 1, 5)) t(no, variant, inst, shots)),
pre AS (SELECT subject, no, string_agg(shown, '' ORDER BY rn) AS prefix FROM dev JOIN v ON rn <= shots GROUP BY subject, no),
t AS (SELECT *, row_number() OVER (ORDER BY doc_key) - 1 AS place FROM md WHERE turn > 1)
SELECT place * 7 + no AS doc_id, variant, CASE WHEN inst = 1 THEN {INST} ELSE '' END || coalesce(prefix, '') || {sql_example(False)} AS ctx_text
FROM t CROSS JOIN v LEFT JOIN pre USING (subject, no)""")
def prompt_variants(spark, sf):
    dev, test = _split(stage(_subject_docs(spark, sf), "subject-docs"))
    return E.prompt_variants(test, dev, 1).select("doc_id", "variant", "ctx_text")


NAMES = [*tasks.CATEGORY_FIELDS, "math", "anatomy"]


def _sql_names() -> str:
    rows = [f"('{n}', {i}, '{s}')" for n in NAMES for i, s in enumerate(tasks.subjects_of(n))]
    return ", ".join(rows)


def _sql_fields() -> str:
    cats = ", ".join(f"('{c}', '{f}', {i})" for c, fs in tasks.CATEGORY_FIELDS.items() for i, f in enumerate(fs))
    subs = ", ".join(f"('{s}', '{f}', {i})" for i, (s, f) in enumerate(tasks.SUBJECT_FIELD.items()))
    return f"""cat AS (SELECT * FROM (VALUES {cats}) t(category, field, fo)), sub AS (SELECT * FROM (VALUES {subs}) t(subject, field, so)),
named AS (SELECT category AS name, row_number() OVER (PARTITION BY category ORDER BY fo, so) - 1 AS ordinal, subject FROM cat JOIN sub USING (field)
  UNION ALL SELECT 'math', row_number() OVER (ORDER BY so) - 1, subject FROM sub WHERE field = 'math'
  UNION ALL SELECT 'anatomy', 0, 'anatomy')"""


@query("category_subjects", f"""WITH {SQL_SUBJECT_DOCS}, {_sql_fields()}
SELECT name, ordinal, subject, count(doc_key) AS n_docs FROM named LEFT JOIN md USING (subject) GROUP BY name, ordinal, subject""")
def category_subjects(spark, sf):
    docs = _subject_docs(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"))
    named = E.category_subjects(spark, NAMES)
    return named.join(docs, "subject", "left").select(
        "name", "ordinal", "subject", F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )


# --- task prompts ----------------------------------------------------------------------


def _task_records(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Records of every task class, made from the multiple-choice items."""
    mc = stage(_multiple_choice(spark, sf), "choices")  # every task reads it
    q, a = F.col("question"), F.col("answer")
    c = [F.element_at("choices", i + 1) for i in range(4)]
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), a + 1)
    digit = (a + 1).cast("string")

    def rows(**fields):
        return mc.select("item_id", *[v.alias(k) for k, v in fields.items()])

    choice_fields = dict(question=q, choices=F.col("choices"), answerKey=F.when(a % 2 == 0, digit).otherwise(letter))
    return {
        "piqa": rows(goal=q, sol1=c[0], sol2=c[1], label=a % 2),
        "hellaswag": rows(
            activity_label=F.lit(" Topic"), ctx_a=F.concat(q, F.lit(" [title] x [noise]  y")),
            ctx_b=F.when(a == 0, F.lit("")).otherwise(F.lit("he Said")), endings=F.col("choices"), label=a.cast("string"),
        ),
        "openbook_qa": rows(question_stem=q, choices=F.col("choices"), answerKey=F.concat(letter, F.lit(" "))),
        "boolq": rows(passage=c[0], question=q, answer=a % 2 == 0),
        "sciq": rows(
            support=F.concat(F.lit("  "), c[0], F.lit("\n")), question=q,
            distractor1=c[1], distractor2=c[2], distractor3=c[3], correct_answer=c[0],
        ),
        "arc_easy": rows(**choice_fields),
        "arc_easy_ppl": rows(**choice_fields),
        "arc_challenge": rows(**choice_fields),
        "basic_arithmetic": rows(**choice_fields),
        "commonsense_qa": rows(**choice_fields),
        "social_iqa": rows(
            context=c[0], question=q, answerA=c[1], answerB=c[2], answerC=c[3], label=(a % 3 + 1).cast("string")
        ),
        "copa": rows(
            premise=q, question=F.when(a % 2 == 0, "cause").otherwise("effect"), choice1=c[0], choice2=c[1], label=a % 2
        ),
        "rte": rows(sentence1=q, sentence2=c[0], label=a % 2),
        "commitment_bank": rows(premise=q, hypothesis=c[0], label=a % 3),
        "mrpc": rows(sentence1=F.concat(q, F.lit(" ' s ( x ) , y")), sentence2=c[0], label=a % 2),
        "sst2": rows(sentence=F.concat(q, F.lit(' did n\'t ( a ) " b " . ')), label=a % 2),
        "mmlu_stem": rows(question=q, choices=F.col("choices"), answer=a),
        "trivia_qa_wiki_ppl": rows(question=q, answer=F.struct(c[0].alias("value"))),
        "natural_qs_open_ppl": rows(question=q, answer=F.array(c[0], c[1])),
    }


def _clean(x: str) -> str:
    return f"replace(regexp_replace(replace({sql_strip(x)}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


def _detok(x: str) -> str:
    for old, new in ((" n''t", "n''t"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')):
        x = f"replace({x}, '{old}', '{new}')"
    return f"regexp_replace({x}, ' ([''.,])', '\\1', 'g')"


def _sql_task(name: str, text: str, conts: list[str] | str, label: str, dc: str = "'Answer:'") -> str:
    joined = conts if isinstance(conts, str) else " || '|' || ".join(f"' ' || {c}" for c in conts)
    return f"SELECT '{name}' AS task, item_id, {text} AS ctx_text, {joined} AS continuations, CAST({label} AS BIGINT) AS label_id, {dc} AS dc_text FROM m"


def _sql_tasks() -> str:
    c = [f"choices[{i}]" for i in range(1, 5)]
    ques = "'Question: ' || q || E'\\nAnswer:'"
    all4 = c
    tail = "(CASE WHEN a = 0 THEN '' ELSE 'He said' END)"
    lastw = "regexp_extract({x}, '[^ ]*$')"
    ctx_a = "q || ' [title] x [noise]  y'"
    copa_c = "CASE WHEN a % 2 = 0 THEN 'because' ELSE 'therefore' END"
    low = "lower(substr({x}, 1, 1)) || substr({x}, 2)"
    rows = [
        _sql_task("piqa", ques, c[:2], "a % 2"),
        _sql_task("hellaswag", _clean(f"(' Topic: ' || {ctx_a} || ' ' || {tail})"), [_clean(x) for x in c], "a",
                  f"CASE WHEN a = 0 THEN {lastw.format(x=_clean('(' + ctx_a + ')'))} ELSE 'He said' END"),
        _sql_task("openbook_qa", "q", all4, "a", lastw.format(x=sql_strip("q"))),
        _sql_task("boolq", "choices[1] || E'\\nQuestion: ' || q || E'?\\nAnswer:'", ["'yes'", "'no'"], "a % 2"),
        _sql_task("sciq", f"{sql_strip('choices[1]')} || E'\\nQuestion: ' || q || E'\\nAnswer:'", [c[1], c[2], c[3], c[0]], "3"),
        *[_sql_task(t, ques, all4, "a") for t in ("arc_easy", "arc_challenge", "basic_arithmetic", "commonsense_qa")],
        _sql_task("arc_easy_ppl", ques, ["choices[CAST(a AS INTEGER) + 1]"], "0"),
        _sql_task("social_iqa", "'Question: ' || choices[1] || ' ' || q || E'\\nAnswer:'", c[1:], "a % 3"),
        _sql_task("copa", f"substr({sql_strip('q')}, 1, length({sql_strip('q')}) - 1) || ' ' || {copa_c}",
                  [low.format(x=c[0]), low.format(x=c[1])], "a % 2", copa_c),
        _sql_task("rte", "q || E'\\nQuestion: ' || choices[1] || E' True or False?\\nAnswer:'", ["'True'", "'False'"], "a % 2"),
        _sql_task("commitment_bank", "q || E'\\nQuestion: ' || choices[1] || E'. True, False or Neither?\\nAnswer:'", ["'True'", "'False'", "'Neither'"], "a % 3"),
        _sql_task("mrpc", f"""'Sentence 1: ' || {_detok("(q || ' '' s ( x ) , y')")} || E'\\nSentence 2: ' || {_detok("choices[1]")} || E'\\nQuestion: Do both sentences mean the same thing?\\nAnswer:'""", ["'yes'", "'no'"], "1 - a % 2"),
        _sql_task("sst2", f"""{_detok("(q || ' did n''t ( a ) " + '" b " . ' + "')")} || E'\\nQuestion: Is this sentence positive or negative?\\nAnswer:'""", ["'negative'", "'positive'"], "a % 2"),
        _sql_task("mmlu_stem", f"'Question: ' || {sql_strip('q')} || E'\\nAnswer:'", all4, "a"),
        _sql_task("trivia_qa_wiki_ppl", "E'\\nQuestion: ' || q || E'\\nAnswer:'", c[:1], "0"),
        _sql_task("natural_qs_open_ppl", "E'\\nQuestion: ' || q || E'\\nAnswer:'", c[:1], "0"),
    ]
    return f"WITH {SQL_MC}, m AS (SELECT item_id, question AS q, choices, answer AS a FROM mc)\n" + "\nUNION ALL ".join(rows)


@query("task_prompts", _sql_tasks())
def task_prompts(spark, sf):
    parts = [
        tasks.task_prompts(records, name, ["item_id"]).withColumn("task", F.lit(name))
        for name, records in _task_records(spark, sf).items()
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.select(
        "task", "item_id", "ctx_text", F.array_join("continuations", "|").alias("continuations"), "label_id", "dc_text"
    )


SUBJECT_TASKS = [name for name in tasks.TASKS if name.startswith("mmlu_")]

SQL_SUBJECT_TASKS = f"""WITH {SQL_SUBJECT_DOCS}, {_sql_fields()},
{sql_shots(False).replace("dev AS", "dev0 AS")}, {sql_shots(True).replace("dev AS", "dev1 AS")},
devs AS (SELECT false AS lettered, * FROM dev0 UNION ALL SELECT true, * FROM dev1),
tasks AS (SELECT DISTINCT 'mmlu_' || category || suffix AS task, category, split, kind, lettered
  FROM cat CROSS JOIN (VALUES ('', 'validation', 'plain', false), ('_test', 'test', 'plain', false), ('_var', 'validation', 'var', false),
                              ('_mc_5shot', 'validation', 'mc', true), ('_mc_5shot_test', 'test', 'mc', true)) s(suffix, split, kind, lettered)),
v AS (SELECT * FROM (VALUES ('plain', 0, 1, 'plain', 0, 0), ('var', 0, 7, 'plain', 0, 0), ('var', 1, 7, 'inst', 1, 0), ('var', 2, 7, 'inst+1', 1, 1),
  ('var', 3, 7, 'inst+2', 1, 2), ('var', 4, 7, 'inst+3', 1, 3), ('var', 5, 7, 'inst+4', 1, 4), ('var', 6, 7, 'inst+5', 1, 5), ('mc', 0, 1, 'inst+5', 1, 5))
  t(kind, no, n, variant, inst, shots)),
pre AS (SELECT subject, lettered, shots, string_agg(shown, '' ORDER BY rn) AS prefix
        FROM devs JOIN (SELECT DISTINCT shots FROM v) ON rn <= shots GROUP BY subject, lettered, shots),
placed AS (SELECT task, kind, lettered, md.*, row_number() OVER (PARTITION BY task ORDER BY doc_key) - 1 AS place
  FROM md JOIN sub USING (subject) JOIN cat USING (field) JOIN tasks USING (category)
  WHERE turn > 1 AND split = CASE WHEN doc_key // 4294967296 % 2 = 0 THEN 'test' ELSE 'validation' END)
SELECT task, place * n + no AS doc_id, variant,
       CASE WHEN inst = 1 THEN {INST} ELSE '' END || coalesce(prefix, '') || CASE WHEN p.lettered THEN {sql_example(True)} ELSE {sql_example(False)} END AS ctx_text,
       CASE WHEN p.lettered THEN ' A| B| C| D' ELSE array_to_string(list_transform(choices, lambda c: ' ' || c), '|') END AS continuations,
       answer AS label_id, 'Answer:' AS dc_text
FROM placed p JOIN v USING (kind) LEFT JOIN (SELECT subject AS s, lettered AS l, shots AS k, prefix FROM pre) ON s = p.subject AND l = p.lettered AND k = v.shots"""


@query("subject_task_prompts", SQL_SUBJECT_TASKS)
def subject_task_prompts(spark, sf):
    """All names of subject tasks; even conversations are the test part."""
    docs = stage(_subject_docs(spark, sf), "subject-docs")
    dev, test = _split(docs)
    part = F.when(F.shiftright("doc_key", 32) % 2 == 0, "test").otherwise("validation")
    out = E.all_subject_prompts(test.withColumn("split", part), dev, SUBJECT_TASKS)
    return out.select("task", "doc_id", "variant", "ctx_text", F.array_join("continuations", "|").alias("continuations"), "label_id", "dc_text")


# --- requests --------------------------------------------------------------------------


def _requests(spark: SparkSession, sf: str, ctx: int = CTX) -> DataFrame:
    docs = dense_position(_subject_docs(spark, sf), "doc_key", out="doc_id")
    prompts = tasks.task_prompts(docs, "mmlu_stem", ["doc_id"])
    return E.expand_requests(prompts, chat_vocab(spark, sf), model_ctx_len=ctx)


def _sql_ids(alias: str, source: str, keys: str, text: str) -> str:
    return f"""{alias} AS (SELECT {keys}, flatten(list({sql_word_ids()} ORDER BY pos)) AS ids
  FROM (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT {keys}, {sql_words(text)} AS ws FROM {source}))
  LEFT JOIN vocab v USING (w) GROUP BY {keys})"""


SQL_REQUESTS = f"""vocab AS ({sql_vocab('conversations')}), {SQL_SUBJECT_DOCS},
docs AS (SELECT doc_key, turn, row_number() OVER (ORDER BY doc_key) - 1 AS doc_id, {sql_example(False)} AS ctx_text, choices, answer FROM md),
conts AS (SELECT doc_id, turn, answer, k AS cont_id, ' ' || choices[CAST(k AS INTEGER) + 1] AS cont_text FROM docs CROSS JOIN {K4}),
{_sql_ids('ctok', 'docs', 'doc_id', 'ctx_text')}, {_sql_ids('ktok', 'conts', 'doc_id, cont_id', 'cont_text')},
dcid AS (SELECT {sql_word_ids('x.w')} AS ids FROM (SELECT 'Answer:' AS w) x LEFT JOIN vocab v ON v.w = x.w),
raw AS (SELECT conts.doc_id, conts.cont_id, conts.answer AS label_id, ctok.ids AS ctx, ktok.ids AS cont, dcid.ids AS dc,
               ctok.ids || ktok.ids[1:len(ktok.ids) - 1] AS full_q, cont_text
        FROM conts JOIN ctok USING (doc_id) JOIN ktok USING (doc_id, cont_id) CROSS JOIN dcid),
req AS (SELECT *, full_q[greatest(len(full_q) - {CTX}, 0) + 1 : len(full_q)] AS query, dc || cont[1:len(cont) - 1] AS dc_query FROM raw)"""


def sql_ids_text(x: str) -> str:
    return f"array_to_string({x}, ' ')"


@query("expand_requests", f"""WITH {SQL_REQUESTS}
SELECT doc_id, cont_id, label_id, len(query) - len(cont) + 1 AS ctx_len, len(dc) AS dc_len, len(cont) AS cont_len,
       length(cont_text) - 1 AS cont_str_len, {sql_ids_text('ctx')} AS ctx, {sql_ids_text('cont')} AS continuation FROM req""")
def expand_requests(spark, sf):
    r = _requests(spark, sf)
    return r.select(
        "doc_id", "cont_id", "label_id", "ctx_len", "dc_len", "cont_len", "cont_str_len",
        joined_ids(F.col("ctx")).alias("ctx"), joined_ids(F.col("continuation")).alias("continuation"),
    )


@query("left_truncate_query", f"""WITH {SQL_REQUESTS.replace(f"len(full_q) - {CTX}", f"len(full_q) - {SHORT_CTX}")}
SELECT doc_id, cont_id, {sql_ids_text('query')} AS query, {sql_ids_text('dc_query')} AS dc_query, len(query) - len(cont) + 1 AS ctx_len FROM req""")
def left_truncate_query(spark, sf):
    r = _requests(spark, sf, SHORT_CTX)
    return r.select(
        "doc_id", "cont_id", joined_ids(F.col("query")).alias("query"), joined_ids(F.col("dc_query")).alias("dc_query"), "ctx_len"
    )


@query("pad_requests", f"""WITH {SQL_REQUESTS},
b AS (SELECT *, (doc_id * 4 + cont_id) // 8 AS batch FROM req),
mx AS (SELECT *, max(len(ctx)) OVER w AS m1, max(len(cont)) OVER w AS m2, max(len(query)) OVER w AS m3, max(len(dc_query)) OVER w AS m4 FROM b WINDOW w AS (PARTITION BY batch))
SELECT batch, doc_id, cont_id, {", ".join(
    f"array_to_string(CASE WHEN len({c}) > {CTX} THEN {c}[len({c}) - {CTX - 1}:] ELSE ({c} || list_transform(range({m} - len({c})), lambda x: CAST(1 AS BIGINT)))[1:{CTX}] END, ' ') AS {n}"
    for c, m, n in (('ctx', 'm1', 'ctx'), ('cont', 'm2', 'continuation'), ('query', 'm3', 'query'), ('dc_query', 'm4', 'dc_query')))} FROM mx""")
def pad_requests(spark, sf):
    r = _requests(spark, sf).withColumn("batch", F.floor((F.col("doc_id") * 4 + F.col("cont_id")) / 8).cast("bigint"))
    padded = E.pad_requests(r, "batch", model_ctx_len=CTX)
    fields = ("ctx", "continuation", "query", "dc_query")
    return padded.select("batch", "doc_id", "cont_id", *[joined_ids(F.col(f)).alias(f) for f in fields])


SQL_WINO = rf"""vocab AS ({sql_vocab('conversations')}),
s AS (SELECT item_id, {sql_words('text')} AS ws, item_id % 2 + 1 AS answer FROM benchmark),
w AS (SELECT item_id, answer, array_to_string(ws[1:3], ' ') || ' ' AS head, ' ' || array_to_string(ws[4:], ' ') AS tail, ws[1] AS o1, ws[-1] AS o2 FROM s),
two AS (SELECT item_id, answer - 1 AS label_id, 0 AS cont_id, head || o1 AS ctx_text, o1 AS dc_text, ' ' || {sql_strip('tail')} AS cont_text FROM w
        UNION ALL SELECT item_id, answer - 1, 1, head || o2, o2, ' ' || {sql_strip('tail')} FROM w),
{_sql_ids('x1', 'two', 'item_id, cont_id', 'ctx_text')}, {_sql_ids('x2', 'two', 'item_id, cont_id', 'cont_text')}, {_sql_ids('x3', 'two', 'item_id, cont_id', 'dc_text')},
j AS (SELECT two.*, x1.ids AS ctx, x2.ids AS cont, x3.ids AS dc, x1.ids || x2.ids[1:len(x2.ids) - 1] AS full_q
      FROM two JOIN x1 USING (item_id, cont_id) JOIN x2 USING (item_id, cont_id) JOIN x3 USING (item_id, cont_id))"""


@query("pair_context_requests", f"""WITH {SQL_WINO}
SELECT item_id AS doc_id, CAST(cont_id AS BIGINT) AS cont_id, label_id, len(ctx) AS ctx_len, len(dc) AS dc_len, len(cont) AS cont_len, length(cont_text) - 1 AS cont_str_len,
       array_to_string(full_q[greatest(len(full_q) - {CTX}, 0) + 1 : len(full_q)], ' ') AS query, array_to_string(dc || cont[1:len(cont) - 1], ' ') AS dc_query FROM j""")
def pair_context_requests(spark, sf):
    ws = words("text")
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"),
        F.concat(F.array_join(F.slice(ws, 1, 3), " "), F.lit(" _ "), F.array_join(F.slice(ws, 4, 2**31 - 1), " ")).alias("sentence"),
        F.element_at(ws, 1).alias("option1"),
        F.element_at(ws, -1).alias("option2"),
        (F.col("item_id") % 2 + 1).cast("string").alias("answer"),
    )
    r = E.pair_context_requests(tasks.pair_context_prompts(items, ["doc_id"]), chat_vocab(spark, sf), model_ctx_len=CTX)
    return r.select(
        "doc_id", "cont_id", "label_id", "ctx_len", "dc_len", "cont_len", "cont_str_len",
        joined_ids(F.col("query")).alias("query"), joined_ids(F.col("dc_query")).alias("dc_query"),
    )


# --- scores ----------------------------------------------------------------------------


def _scored_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, cont_id, label_id, grp, cont_len, cont_str_len) without token ids."""
    docs = dense_position(_subject_docs(spark, sf), "doc_key", out="doc_id")
    return docs.select(
        "doc_id", F.col("answer").alias("label_id"), F.col("turn").alias("grp"), F.posexplode("choices").alias("cont_id", "choice")
    ).select(
        "doc_id", F.col("cont_id").cast("bigint").alias("cont_id"), "label_id", "grp",
        F.size(words("choice")).alias("cont_len"), F.length("choice").cast("bigint").alias("cont_str_len"),
    )


def _fake(prefix: str):
    """What a model would return: a number in [-1.001, -0.001] from the key."""
    key = F.concat_ws(":", *([F.lit(prefix)] if prefix else []), "doc_id", "cont_id", "pos")
    return -(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("bigint") / F.lit(65536.0)) - F.lit(0.001)


def _logprobs(requests: DataFrame) -> DataFrame:
    tokens = requests.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("cont_len") - 1)))
    return tokens.select(
        "doc_id", "cont_id", "pos", (F.col("doc_id") * 4 + F.col("cont_id")).alias("arrival"),
        _fake("").alias("logprob"), _fake("dc").alias("dc_logprob"),
    )


def _sql_fake(prefix: str) -> str:
    lead = f"'{prefix}:' || " if prefix else ""
    return f"(-(CAST('0x' || substr(md5({lead}doc_id || ':' || cont_id || ':' || pos), 1, 4) AS BIGINT) / 65536.0) - 0.001)"


SQL_LOGPROBS = f"""{SQL_SUBJECT_DOCS},
docs AS (SELECT *, row_number() OVER (ORDER BY doc_key) - 1 AS doc_id FROM md),
rq AS (SELECT doc_id, k AS cont_id, answer AS label_id, turn AS grp, len({sql_words('choices[CAST(k AS INTEGER) + 1]')}) AS cont_len,
              length(choices[CAST(k AS INTEGER) + 1]) AS cont_str_len FROM docs CROSS JOIN {K4}),
lp AS (SELECT doc_id, cont_id, pos, {_sql_fake('')} AS logprob, {_sql_fake('dc')} AS dc_logprob, {_sql_fake('dup')} AS dup_logprob
       FROM (SELECT doc_id, cont_id, unnest(range(cont_len)) AS pos FROM rq)),
sums AS (SELECT doc_id, cont_id, sum(logprob) AS s, sum(dc_logprob) AS d, sum(dup_logprob) AS u FROM lp GROUP BY doc_id, cont_id)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query("continuation_loglik", f"WITH {SQL_LOGPROBS} SELECT doc_id, cont_id, round(s, 9) AS score FROM sums")
def continuation_loglik(spark, sf):
    return _rounded(E.continuation_loglik(_logprobs(_scored_requests(spark, sf))))


@query("length_normalised_loglik", f"""WITH {SQL_LOGPROBS}
SELECT doc_id, cont_id, round(s / cont_str_len, 9) AS score, round(-(s / cont_str_len), 9) AS ce_loss FROM sums JOIN rq USING (doc_id, cont_id)""")
def length_normalised_loglik(spark, sf):
    requests = _scored_requests(spark, sf)
    scored = E.length_normalised_loglik(_logprobs(requests), requests)
    return scored.select("doc_id", "cont_id", F.round("score", 9).alias("score"), F.round(-F.col("score"), 9).alias("ce_loss"))


@query("domain_conditional_loglik", f"WITH {SQL_LOGPROBS} SELECT doc_id, cont_id, round(s / d, 9) AS score FROM sums")
def domain_conditional_loglik(spark, sf):
    return _rounded(E.domain_conditional_loglik(_logprobs(_scored_requests(spark, sf))))


def _with_repeats(logprobs: DataFrame) -> DataFrame:
    """Every continuation twice: once more, later, with other values."""
    later = logprobs.withColumn("arrival", F.col("arrival") + 1_000_000).withColumn("logprob", _fake("dup"))
    return logprobs.unionByName(later)


@query("dedup_first", f"""WITH {SQL_LOGPROBS} SELECT doc_id, cont_id, round(s, 9) AS score FROM sums""")
def dedup_first(spark, sf):
    twice = _with_repeats(_logprobs(_scored_requests(spark, sf)))
    sums = E.continuation_loglik(twice, ["doc_id", "cont_id", "arrival"])
    return _rounded(E.dedup_first(sums))


def _with_gaps(scores: DataFrame) -> DataFrame:
    """Some documents lose a middle continuation, some the last."""
    middle = (F.col("doc_id") % 3 == 0) & (F.col("cont_id") == 1)
    tail = (F.col("doc_id") % 3 == 1) & (F.col("cont_id") == 3)
    return scores.where(~middle & ~tail)


SQL_GAPS = "gaps AS (SELECT * FROM sums WHERE NOT (doc_id % 3 = 0 AND cont_id = 1) AND NOT (doc_id % 3 = 1 AND cont_id = 3))"


@query("complete_docs", f"""WITH {SQL_LOGPROBS}, {SQL_GAPS}
SELECT doc_id, count(*) AS n_conts FROM gaps GROUP BY doc_id HAVING max(cont_id) < count(*)""")
def complete_docs(spark, sf):
    return E.complete_docs(_with_gaps(E.continuation_loglik(_logprobs(_scored_requests(spark, sf)))))


SQL_BEST = f"""{SQL_LOGPROBS}, {SQL_GAPS},
best AS (SELECT doc_id, cont_id AS choice FROM gaps QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cont_id) = 1),
fine AS (SELECT doc_id FROM gaps GROUP BY doc_id HAVING max(cont_id) < count(*)),
j AS (SELECT b.doc_id, choice, label_id, grp FROM best b SEMI JOIN fine USING (doc_id) JOIN (SELECT DISTINCT doc_id, label_id, grp FROM rq) USING (doc_id))"""


def _choices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    requests = _scored_requests(spark, sf)
    scores = _with_gaps(E.continuation_loglik(_logprobs(requests)))
    labels = requests.where("cont_id = 0").select("doc_id", "label_id", "grp")
    return E.choose(scores), labels


@query("choice_accuracy", f"""WITH {SQL_BEST}
SELECT grp, round(avg(CASE WHEN choice = label_id THEN 1.0 ELSE 0.0 END), 9) AS value, count(*) AS n_docs FROM j GROUP BY grp""")
def choice_accuracy(spark, sf):
    chosen, labels = _choices(spark, sf)
    return E.choice_accuracy(chosen, labels, ["grp"]).withColumn("value", F.round("value", 9))


@query("choice_f1", f"""WITH {SQL_BEST},
n AS (SELECT grp, count(*) FILTER (choice = 0 AND label_id = 0) AS tp, count(*) FILTER (choice = 0 AND label_id <> 0) AS fp,
             count(*) FILTER (choice <> 0 AND label_id = 0) AS fn FROM j GROUP BY grp)
SELECT grp, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 9) AS value FROM n""")
def choice_f1(spark, sf):
    chosen, labels = _choices(spark, sf)
    return E.choice_f1(chosen, labels, ["grp"]).withColumn("value", F.round("value", 9))


@query("answer_ce", f"""WITH {SQL_LOGPROBS}
SELECT grp, round(avg(-(s / cont_str_len)), 9) AS value, count(*) AS n_docs FROM sums JOIN rq USING (doc_id, cont_id) WHERE cont_id = 0 GROUP BY grp""")
def answer_ce(spark, sf):
    requests = _scored_requests(spark, sf)
    scores = E.length_normalised_loglik(_logprobs(requests), requests, negate=True)
    grouped = scores.join(requests.select("doc_id", "cont_id", "grp"), ["doc_id", "cont_id"])
    return E.answer_ce(grouped, ["grp"]).withColumn("value", F.round("value", 9))


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("label"), (seeded_unit(SEED, "doc_id") * 4).alias("loss"))


@query("label_metric_router", f"""
SELECT lang AS label, round(sum({sql_unit(SEED, 'doc_id')} * 4), 6) AS total, count(*) AS weight FROM documents GROUP BY lang""")
def label_metric_router(spark, sf):
    return E.label_metric_router(_losses(spark, sf)).withColumn("total", F.round("total", 6))


@query("perplexity_by_label", f"""
WITH m AS (SELECT lang, avg({sql_unit(SEED, 'doc_id')} * 4) AS ce FROM documents GROUP BY lang)
SELECT 'eval/' || lang || '/CrossEntropyLoss' AS metric, round(ce, 9) AS value FROM m
UNION ALL SELECT 'eval/' || lang || '/Perplexity', round(exp(ce), 9) FROM m""")
def perplexity_by_label(spark, sf):
    return E.perplexity_by_label(_losses(spark, sf)).withColumn("value", F.round("value", 9))


@query("instance_loss", f"""WITH {SQL_CHAT_FIT}
SELECT conv_id, round(avg(CASE WHEN lab THEN CAST('0x' || substr(md5(conv_id || ':' || p), 1, 4) AS BIGINT) / 65536.0 ELSE 0 END), 9) AS loss
FROM fit WHERE p >= 1 GROUP BY conv_id""")
def instance_loss(spark, sf):
    rows = _chat_rows(spark, sf)
    tokens = rows.select("conv_id", F.posexplode("label_mask").alias("p", "lab")).where("p >= 1")
    value = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "p")), 1, 4), 16, 10).cast("bigint") / F.lit(65536.0)
    losses = tokens.select("conv_id", F.when(F.col("lab"), value).alias("loss"))
    return E.instance_loss(losses, "conv_id").withColumn("loss", F.round("loss", 9))


@query("extract_choice", r"""
WITH r AS (SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 5 < 4 THEN ' Therefore, the answer is (' || substr('ABCD', CAST((conv_id + turn) % 5 AS INTEGER) + 1, 1) || ').' ELSE '' END AS response,
                  substr('ABCD', CAST((conv_id + 2 * turn) % 4 AS INTEGER) + 1, 1) AS gold FROM conversations WHERE role = 'assistant'),
x AS (SELECT gold, regexp_extract(response, 'Therefore, the answer is \(([A-D])\)', 1) AS e FROM r)
SELECT gold, count(*) AS n, count(*) FILTER (e = '') AS n_unstated, round(avg(CASE WHEN e = gold THEN 1.0 ELSE 0.0 END), 9) AS exact_match FROM x GROUP BY gold""")
def extract_choice(spark, sf):
    k = F.col("conv_id") + F.col("turn")
    stated = F.concat(F.lit(" Therefore, the answer is ("), F.substring(F.lit("ABCD"), (k % 5 + 1).cast("int"), F.lit(1)), F.lit(")."))
    responses = table(spark, sf, "conversations").where("role = 'assistant'").select(
        F.concat("text", F.when(k % 5 < 4, stated).otherwise(F.lit(""))).alias("response"),
        F.substring(F.lit("ABCD"), ((F.col("conv_id") + 2 * F.col("turn")) % 4 + 1).cast("int"), F.lit(1)).alias("gold"),
    )
    return E.extract_choice(responses).groupBy("gold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("extracted") == "", 1)).alias("n_unstated"),
        F.round(F.avg(F.col("match").cast("double")), 9).alias("exact_match"),
    )


@query("instruction_levels", """
WITH c AS (SELECT l_orderkey, l_quantity > 20 AS strict, l_quantity > 10 AS loose FROM lineitem),
p AS (SELECT l_orderkey, bool_and(strict) AS s, bool_and(loose) AS l FROM c GROUP BY l_orderkey)
SELECT 'prompt_level_strict_acc' AS metric, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 9) AS value FROM p
UNION ALL SELECT 'prompt_level_loose_acc', round(avg(CASE WHEN l THEN 1.0 ELSE 0.0 END), 9) FROM p
UNION ALL SELECT 'inst_level_strict_acc', round(avg(CASE WHEN strict THEN 1.0 ELSE 0.0 END), 9) FROM c
UNION ALL SELECT 'inst_level_loose_acc', round(avg(CASE WHEN loose THEN 1.0 ELSE 0.0 END), 9) FROM c""")
def instruction_levels(spark, sf):
    checks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), (F.col("l_quantity") > 20).alias("strict"), (F.col("l_quantity") > 10).alias("loose")
    )
    return E.instruction_levels(checks).withColumn("value", F.round("value", 9))


BENCHMARKS = [row[0] for row in E.INSTRUCT]
REGISTRY_VALUES = ", ".join(f"({i}, '{b}', {s}, '{m}', '{a}')" for i, (b, s, m, a) in enumerate(E.INSTRUCT))


@query("benchmark_summary", f"""
WITH reg AS (SELECT * FROM (VALUES {REGISTRY_VALUES}) t(no, benchmark, shots, metric, alias)),
res AS (SELECT l_returnflag AS model, (l_linenumber + l_suppkey) % 8 AS no, avg(l_discount) * 100 AS value FROM lineitem GROUP BY ALL),
ok AS (SELECT model, benchmark, value FROM res JOIN reg USING (no) WHERE alias LIKE '%::%')
SELECT model, {", ".join(f"round(avg(value) FILTER (benchmark = '{b}'), 9) AS {c}" for b, c in zip(BENCHMARKS, [x.lower().replace(' ', '_') for x in BENCHMARKS]))},
       round(avg(value), 9) AS mean FROM ok GROUP BY model""")
def benchmark_summary(spark, sf):
    names = F.array(*[F.struct(F.lit(s).cast("bigint").alias("shots"), F.lit(a if "::" in a else m).alias("alias"),
                               F.lit(m if "::" in a else a).alias("metric")) for _, s, m, a in E.INSTRUCT])
    lines = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), ((F.col("l_linenumber") + F.col("l_suppkey")) % 8).alias("no")
    ).agg((F.avg("l_discount") * 100).alias("value"))
    results = lines.withColumn("b", F.element_at(names, (F.col("no") + 1).cast("int"))).select("model", "value", "b.*")
    wide = E.benchmark_summary(results, E.benchmark_registry(spark, E.INSTRUCT), BENCHMARKS)
    return wide.select(
        "model", *[F.round(F.col(f"`{b}`"), 9).alias(b.lower().replace(" ", "_")) for b in BENCHMARKS], F.round("mean", 9).alias("mean")
    )
