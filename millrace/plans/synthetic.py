"""Queries over synthetic maths data: orders stand for cases, order lines for candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions import prompt_texts as P
from millrace.functions.text import last_number
from millrace.operators import cycle, quality, synthetic as S
from millrace.plans.registry import query, spread_table, table, text_literal
from millrace.plans.shared import SEED, sql_float, sql_last_number, sql_md5, sql_strip
from millrace.session import fresh_path, stage
from millrace.sources.commits import CommitLog

# --- derived inputs --------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a unique, ordered number per order, made of the line's own keys.

    Order and uniqueness are all that is needed, so no order is sorted to number its lines.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    digest = F.md5(F.concat_ws(":", "l_partkey", "l_suppkey", cents))
    place = F.col("l_linenumber").cast("bigint") * 10**17 + F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return spread_table(spark, sf, "lineitem", *columns).select(
        F.col("l_orderkey").alias("case_id"),
        place.alias("ordinal"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    first = _lines(spark, sf).groupBy("case_id").agg(F.min_by("q", "ordinal").cast("string").alias("q"))
    orders = spread_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").cast("string").alias("cust"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("price"),
        F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "P", 0.0).alias("correct"),
    )
    question = F.concat(
        F.lit("Customer "), "cust", F.lit(" bought 12 inches of rope and "), "q",
        F.lit(" boxes for "), "price", F.lit(" dollars. How many boxes?"),
    )
    told = F.when(F.col("case_id") % 11 == 0, F.concat(F.lit("1,"), F.lpad("q", 3, "0"))).otherwise(F.col("q"))
    return orders.join(first, "case_id").select(
        "case_id",
        "correct",
        "q",
        "price",
        question.alias("question"),
        F.concat(F.lit("They bought "), "q", F.lit(" boxes.\n#### "), told).alias("answer"),
        F.concat(F.lit("num_x="), "q", F.lit(", price_y="), "price").alias("parameters"),
    )


SQL_LINES = """
lines_ AS (SELECT l_orderkey AS case_id, CAST(l_linenumber AS BIGINT) * 100000000000000000 +
    CAST('0x' || substr(md5(l_partkey || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT)), 1, 14) AS BIGINT) AS ordinal,
                  CAST(l_quantity AS BIGINT) AS q, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""

SQL_CASES = f"""{SQL_LINES},
cases AS (
  SELECT o_orderkey AS case_id, CAST(CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 0 END AS DOUBLE) AS correct,
         CAST(q AS VARCHAR) AS q, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
         'Customer ' || o_custkey || ' bought 12 inches of rope and ' || q || ' boxes for ' || CAST(floor(o_totalprice) AS BIGINT) || ' dollars. How many boxes?' AS question,
         'They bought ' || q || E' boxes.\\n#### ' || CASE WHEN o_orderkey % 11 = 0 THEN '1,' || lpad(CAST(q AS VARCHAR), 3, '0') ELSE CAST(q AS VARCHAR) END AS answer,
         'num_x=' || q || ', price_y=' || CAST(floor(o_totalprice) AS BIGINT) AS parameters
  FROM orders JOIN (SELECT case_id, arg_min(q, ordinal) AS q FROM lines_ GROUP BY case_id) ON case_id = o_orderkey)"""


def _masking_response():
    last = F.when(F.col("case_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), "parameters"))
    return F.concat(
        F.lit('\nWe identify the numbers.\n"'), "q", F.lit(' boxes" to "Number of Boxes X" (num_x: int)\n'),
        F.lit('"12 inches" to "Length Y" (length_y: float)\n"12" to " Number Z" (num_z: int)\n'),
        F.lit('"broken" to nothing\n"rope" to "no code"\n"'), "price", F.lit('" to "Price W" (w: int) (price_w: int)\n'),
        F.lit('"12 inches" to "Length V" (length_v: float)\nSo the question becomes\nAbstract '), "q",
        F.lit("\nWith parameters"), last,
    )


SQL_RESPONSES = f"""{SQL_CASES},
resp AS (SELECT *, E'\\nWe identify the numbers.\\n"' || q || E' boxes" to "Number of Boxes X" (num_x: int)\\n' ||
  E'"12 inches" to "Length Y" (length_y: float)\\n"12" to " Number Z" (num_z: int)\\n"broken" to nothing\\n"rope" to "no code"\\n"' || price ||
  E'" to "Price W" (w: int) (price_w: int)\\n"12 inches" to "Length V" (length_v: float)\\nSo the question becomes\\nAbstract ' || q ||
  E'\\nWith parameters' || CASE WHEN case_id % 5 = 0 THEN '' ELSE E'\\n' || parameters END AS response FROM cases),
ln AS (SELECT case_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n
       FROM (SELECT case_id, string_split({sql_strip('response')}, E'\\n') AS ls FROM resp)),
ent AS (SELECT case_id, i, regexp_extract_all(line, '"([^"]*)"', 1) AS t, regexp_extract_all(line, '\\([^"]*\\)') AS c FROM ln WHERE starts_with(line, '"')),
good AS (SELECT case_id, i, {sql_strip('t[1]')} AS key, {sql_strip('t[2]')} AS label, substr(c[-1], 2, length(c[-1]) - 2) AS code FROM ent WHERE len(t) = 2 AND len(c) > 0),
rep AS (SELECT case_id, key, min(i) AS i0, arg_max(label, i) AS label, arg_max(code, i) AS code FROM good GROUP BY case_id, key),
ord1 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY i0) AS rn FROM rep),
ord2 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY length(key) DESC, key DESC) AS rn FROM rep),
ap1(case_id, k, t) AS (SELECT case_id, 0, question FROM cases UNION ALL
  SELECT a.case_id, k + 1, replace(t, key, label || ' (' || code || ')') FROM ap1 a JOIN ord1 o ON o.case_id = a.case_id AND o.rn = k + 1),
ap2(case_id, k, t) AS (SELECT case_id, 0, question FROM cases UNION ALL
  SELECT a.case_id, k + 1, replace(t, key, label || ' (' || code || ')') FROM ap2 a JOIN ord2 o ON o.case_id = a.case_id AND o.rn = k + 1),
m1 AS (SELECT case_id, arg_max(t, k) AS masked FROM ap1 GROUP BY case_id),
m2 AS (SELECT case_id, arg_max(t, k) AS masked FROM ap2 GROUP BY case_id)"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_masking_response(_cases(spark, sf).withColumn("response", _masking_response()).drop("parameters"))


# --- prompts ---------------------------------------------------------------------------


def _exploded_messages(df: DataFrame, messages, *keys: str) -> DataFrame:
    rows = df.select(*keys, F.posexplode(messages).alias("pos", "m"))
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), "m.role", F.md5("m.content").alias("content_md5"))


_MASK_ROWS = [("system", P.MASK_SYSTEM)] + [m for q, a in P.MASK_EXAMPLES for m in (("user", q), ("assistant", a))]


@query("fewshot_messages", f"""WITH {SQL_CASES},
ex AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r}', {text_literal(c)})" for i, (r, c) in enumerate(_MASK_ROWS))}) t(pos, role, content))
SELECT case_id, CAST(pos AS BIGINT) AS pos, role, md5(content) AS content_md5 FROM cases CROSS JOIN ex
UNION ALL SELECT case_id, {len(_MASK_ROWS)}, 'user', md5(question) FROM cases""")
def fewshot_messages(spark, sf):
    return _exploded_messages(_cases(spark, sf), S.fewshot_messages(F.col("question")), "case_id")


_PROGRAM_ROWS = P.PROGRAM_EXAMPLES + [(P.PROGRAM_DRAWN_QUESTION, "")]


@query("program_prompts", f"""WITH RECURSIVE {SQL_RESPONSES},
ex AS (SELECT * FROM (VALUES {", ".join(f"({i}, {text_literal(q)}, {text_literal(a)})" for i, (q, a) in enumerate(_PROGRAM_ROWS))}) t(i, q, a)),
drawn AS (SELECT case_id, CASE WHEN CAST('0x' || substr({sql_md5(SEED, "'coin'", 'case_id')}, 1, 8) AS BIGINT) % 2 = 0
            THEN {text_literal(P.PROGRAM_DRAWN_ANSWERS[0])} ELSE {text_literal(P.PROGRAM_DRAWN_ANSWERS[1])} END AS d FROM cases),
sh AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {sql_md5(SEED, 'case_id', 'i')}, i) AS rn, ex.q, CASE WHEN i = 3 THEN d ELSE a END AS a FROM drawn CROSS JOIN ex)
SELECT case_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, md5({text_literal(P.PROGRAM_SYSTEM)}) AS content_md5 FROM cases
UNION ALL SELECT case_id, rn * 2 - 1, 'user', md5(q) FROM sh UNION ALL SELECT case_id, rn * 2, 'assistant', md5(a) FROM sh
UNION ALL SELECT case_id, 9, 'user', md5(masked) FROM m2""")
def program_prompts(spark, sf):
    messages = S.program_prompts(F.col("question"), F.col("replacement"), SEED, F.col("case_id"))
    return _exploded_messages(_parsed(spark, sf), messages, "case_id")


def _fill_sql(template: str, **values: str) -> str:
    out = text_literal(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


SQL_NEW_PARAMS = f"""newp AS (SELECT case_id, string_agg('num_x=' || q, E'\\n' ORDER BY ordinal) AS np
  FROM lines_ GROUP BY case_id)"""


@query("perturb_prompts", f"""WITH {SQL_CASES}, {SQL_NEW_PARAMS}
SELECT case_id, 'perturb' AS kind, md5({_fill_sql(P.PERTURB_PARAMETERS, question='question', parameters='parameters')}) AS prompt_md5 FROM cases
UNION ALL SELECT case_id, 'rewrite', md5({_fill_sql(P.REWRITE_QUESTION, question='question', parameters='parameters', new_parameters='np')}) FROM cases JOIN newp USING (case_id)
UNION ALL SELECT case_id, 'answer', md5({_fill_sql(P.ANSWER_QUESTION, question='question')}) FROM cases
UNION ALL SELECT case_id, 'answer with examples', md5({_fill_sql(P.ANSWER_QUESTION_WITH_EXAMPLES, question='question')}) FROM cases""")
def perturb_prompts(spark, sf):
    lines = _lines(spark, sf).groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "q"))), lambda x: F.concat(F.lit("num_x="), x["q"].cast("string"))).alias("np")
    )
    cases = _cases(spark, sf).join(lines, "case_id")
    q, p = F.col("question"), F.col("parameters")
    kinds = {
        "perturb": S.perturb_prompt(q, p),
        "rewrite": S.rewrite_prompt(q, p, F.col("np")),
        "answer": S.answer_prompt(q, examples=False),
        "answer with examples": S.answer_prompt(q),
    }
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.md5(F.element_at(m, 2)["content"]).alias("prompt_md5")) for k, m in kinds.items()])
    return cases.select("case_id", F.inline(every))


# --- responses -------------------------------------------------------------------------


@query("parse_masking_response", f"""WITH RECURSIVE {SQL_RESPONSES}
SELECT cases.case_id, (SELECT string_agg(key || '=' || label || '/' || code, ';' ORDER BY i0) FROM rep WHERE rep.case_id = cases.case_id) AS replacement,
       CASE WHEN case_id % 5 = 0 THEN '' ELSE parameters END AS parameters, 'Abstract ' || q AS stated_question, masked AS masked_question
FROM cases JOIN m1 USING (case_id)""")
def parse_masking_response(spark, sf):
    shown = F.array_join(F.transform("replacement", lambda e: F.concat(e["key"], F.lit("="), e["label"], F.lit("/"), e["code"])), ";")
    return _parsed(spark, sf).select("case_id", shown.alias("replacement"), "parameters", "stated_question", "masked_question")


@query("apply_replacements", f"""WITH RECURSIVE {SQL_RESPONSES}
SELECT case_id, m1.masked AS in_order, m2.masked AS longest_first FROM m1 JOIN m2 USING (case_id)""")
def apply_replacements(spark, sf):
    q, r = F.col("question"), F.col("replacement")
    return _parsed(spark, sf).select(
        "case_id", S.apply_replacements(q, r).alias("in_order"), S.apply_replacements(q, r, True).alias("longest_first")
    )


def _programs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a program response and the text its run printed."""
    q, part, supp = F.col("q").cast("string"), F.col("part"), F.col("supp")
    value = F.when(supp % 3 == 0, F.concat(F.lit("math.floor("), q, F.lit(")"))).otherwise(q)
    body = F.when(part % 13 == 0, F.lit("def answer(x):\n    while True: pass\n")).otherwise(
        F.concat(F.lit("def answer(x):\n    return "), value, F.lit("\n"))
    )
    fence = F.when(supp % 4 == 0, F.lit("```python\n")).otherwise(F.lit(""))
    end = F.when(supp % 2 == 0, F.lit("# The Program Ends here.\nprint(1)")).otherwise(F.lit("print(2)"))
    response = F.when(part % 17 == 0, F.lit("no code at all")).otherwise(F.concat(F.lit("Here it is:\n"), fence, body, end))
    result = F.when(part % 7 == 0, F.lit("n/a")).when(part % 7 == 1, F.concat(q, F.lit(".0"))).when(
        part % 7 == 2, F.concat(q, F.lit(".5"))
    ).otherwise(q)
    return _lines(spark, sf).withColumn("response", response).withColumn("result", result)


SQL_PROGRAMS = f"""{SQL_CASES},
pr AS (SELECT *, CASE WHEN part % 17 = 0 THEN 'no code at all' ELSE E'Here it is:\\n' || CASE WHEN supp % 4 = 0 THEN E'```python\\n' ELSE '' END ||
    CASE WHEN part % 13 = 0 THEN E'def answer(x):\\n    while True: pass\\n' ELSE E'def answer(x):\\n    return ' || CASE WHEN supp % 3 = 0 THEN 'math.floor(' || q || ')' ELSE CAST(q AS VARCHAR) END || E'\\n' END ||
    CASE WHEN supp % 2 = 0 THEN E'# The Program Ends here.\\nprint(1)' ELSE 'print(2)' END END AS response,
    CASE part % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN q || '.0' WHEN 2 THEN q || '.5' ELSE CAST(q AS VARCHAR) END AS result FROM lines_),
pl AS (SELECT case_id, ordinal, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT case_id, ordinal, string_split(response, E'\\n') AS ls FROM pr)),
st AS (SELECT case_id, ordinal, min(i) FILTER (starts_with(line, 'def') OR starts_with(line, '''''''')) AS s FROM pl GROUP BY case_id, ordinal),
en AS (SELECT pl.case_id, pl.ordinal, min(s) AS s, min(i) FILTER (i >= s AND (contains(lower(line), 'program ends') OR contains(line, '```'))) AS e
       FROM pl JOIN st USING (case_id, ordinal) GROUP BY pl.case_id, pl.ordinal),
cl AS (SELECT pl.case_id, pl.ordinal, coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (s IS NOT NULL AND i >= s AND (e IS NULL OR i < e)), '') AS program
       FROM pl JOIN en USING (case_id, ordinal) GROUP BY pl.case_id, pl.ordinal),
cand AS (SELECT pr.*, program FROM pr JOIN cl USING (case_id, ordinal))"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _programs(spark, sf).withColumn("program", S.clean_program(F.col("response")))


@query("clean_program", f"WITH {SQL_PROGRAMS} SELECT case_id, ordinal, program FROM cand")
def clean_program(spark, sf):
    return _candidates(spark, sf).select("case_id", "ordinal", "program")


@query("append_candidates", f"""WITH {SQL_PROGRAMS},
nx AS (SELECT case_id, max(ordinal) + 1 AS nx FROM cand GROUP BY case_id)
SELECT case_id, ordinal, program FROM cand
UNION ALL SELECT o_orderkey, coalesce(nx, 0), 'def answer(x): return ' || o_custkey FROM orders LEFT JOIN nx ON case_id = o_orderkey""")
def append_candidates(spark, sf):
    returned = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.concat(F.lit("Sure:\ndef answer(x): return "), F.col("o_custkey").cast("string"), F.lit("\n```")).alias("response"),
    )
    return S.append_candidates(_candidates(spark, sf), returned)


@query("gold_answer", f"""WITH {SQL_CASES},
t AS (SELECT case_id, regexp_extract_all(answer, '[^ \\t\\n\\r]+')[-1] AS gold_text FROM cases)
SELECT case_id, gold_text, {sql_float('gold_text')} AS gold FROM t""")
def gold_answer(spark, sf):
    from millrace.functions.text import last_token

    return _cases(spark, sf).select(
        "case_id", last_token("answer").alias("gold_text"), S.gold_number(F.col("answer")).alias("gold")
    )


SQL_GOLD = f"""gold AS (SELECT case_id, {sql_float("regexp_extract_all(answer, '[^ \\t\\n\\r]+')[-1]")} AS g FROM cases),
res AS (SELECT cand.*, g, {sql_float('result')} AS r FROM cand JOIN gold USING (case_id))"""


@query("score_candidates", f"""WITH {SQL_PROGRAMS}, {SQL_GOLD}
SELECT case_id, count(*) AS n_candidates, round(count(*) FILTER (r = g) * 100 / CAST(count(*) AS DOUBLE), 9) AS correct FROM res GROUP BY case_id""")
def score_candidates(spark, sf):
    scored = S.score_candidates(_programs(spark, sf), _cases(spark, sf))
    return scored.withColumn("correct", F.round("correct", 9))


SQL_CORRECT = f"""{SQL_PROGRAMS}, {SQL_GOLD},
fits AS (SELECT case_id, ordinal, CASE WHEN contains(program, 'math.') THEN E'import math\\n\\n' ELSE '' END || program AS program FROM res WHERE round_even(r, 0) = round_even(g, 0)),
best AS (SELECT case_id, min(ordinal) AS ordinal, arg_min(program, ordinal) AS program FROM fits GROUP BY case_id)"""


def _first_correct(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_correct_program(_programs(spark, sf), _cases(spark, sf), program="response", clean=S.clean_program)


@query("first_correct_program", f"WITH {SQL_CORRECT} SELECT case_id, ordinal, program FROM best")
def first_correct_program(spark, sf):
    return _first_correct(spark, sf)


def _parameter_response():
    """Five lines, or six with a heading when the case number is odd."""
    head = F.when(F.col("case_id") % 2 == 1, F.lit("Parameters:\nNew values\n")).otherwise(F.lit("```\n"))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{i}. - num_x="), (F.col("q").cast("bigint") + i).cast("string")) for i in range(1, 6)])
    return F.concat(head, lines, F.lit("\n\n```"))


SQL_PARAM_LINES = f"""pa AS (SELECT case_id, CASE WHEN case_id % 2 = 1 THEN E'Parameters:\\nNew values\\n' ELSE E'```\\n' END ||
   {" || E'\\n' || ".join(f"'{i}. - num_x=' || (CAST(q AS BIGINT) + {i})" for i in range(1, 6))} || E'\\n\\n```' AS response FROM cases),
pb AS (SELECT case_id, list_filter(string_split({sql_strip("replace(replace(replace(response, 'Parameters:', ''), '```', ''), '- ', '')")}, E'\\n'), lambda x: length(x) > 0) AS l FROM pa),
pc AS (SELECT case_id, CASE WHEN len(l) = 6 THEN l[2:] ELSE l END AS l FROM pb),
params AS (SELECT case_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS slot FROM pc)"""


@query("parse_parameter_lines", f"WITH {SQL_CASES}, {SQL_PARAM_LINES} SELECT case_id, slot, line FROM params")
def parse_parameter_lines(spark, sf):
    rows = _cases(spark, sf).select("case_id", F.posexplode(S.parse_parameter_lines(_parameter_response())).alias("slot", "line"))
    return rows.withColumn("slot", F.col("slot").cast("bigint"))


@query("parse_question_lines", f"""WITH {SQL_CASES},
pa AS (SELECT case_id, string_split(CASE WHEN case_id % 2 = 1 THEN E'Here:\\n' ELSE '' END || E'  \\n' || question || E' \\n\\n' || answer || E'\\n\\n  last one', E'\\n') AS l FROM cases),
pb AS (SELECT case_id, list_transform(list_filter(l, lambda x: length(x) > 0), lambda x: {sql_strip('x')}) AS l FROM pa),
pc AS (SELECT case_id, CASE WHEN len(l) = 6 THEN l[2:] ELSE l END AS l FROM pb)
SELECT case_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS slot FROM pc""")
def parse_question_lines(spark, sf):
    head = F.when(F.col("case_id") % 2 == 1, F.lit("Here:\n")).otherwise(F.lit(""))
    response = F.concat(head, F.lit("  \n"), "question", F.lit(" \n\n"), "answer", F.lit("\n\n  last one"))
    rows = _cases(spark, sf).select("case_id", F.posexplode(S.parse_question_lines(response)).alias("slot", "line"))
    return rows.withColumn("slot", F.col("slot").cast("bigint"))


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    params = _cases(spark, sf).select("case_id", S.parse_parameter_lines(_parameter_response()).alias("new_parameters"))
    return S.build_calls(params.join(_first_correct(spark, sf).select("case_id", "program"), "case_id"))


SQL_CALLS = f"""{SQL_CORRECT}, {SQL_PARAM_LINES},
calls AS (SELECT case_id, slot, line AS parameter, program || E'\\noutput = answer(' || line || E')\\nprint(output)' AS call FROM params JOIN best USING (case_id))"""


@query("build_calls", f"WITH {SQL_CALLS} SELECT case_id, slot, parameter, call FROM calls")
def build_calls(spark, sf):
    return _calls(spark, sf).drop("dead_loop")


@query("drop_dead_loops", f"""WITH {SQL_CALLS}
SELECT count(*) FILTER (NOT contains(call, 'while True:')) AS n_calls, count(*) FILTER (contains(call, 'while True:')) AS n_dead_loops FROM calls""")
def drop_dead_loops(spark, sf):
    return S.dead_loop_counts(_calls(spark, sf))


# --- variants --------------------------------------------------------------------------


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, slot, new_question, new_answer, new_prediction), one per order line."""
    q = F.col("q").cast("string")
    kind = F.col("part") % 5
    thousand = (F.col("q") + 1000).cast("string")
    prediction = (
        F.when(kind == 0, F.concat(F.lit("The answer is "), q, F.lit(".")))
        .when(kind == 1, F.concat(F.lit("Then 3 + 4, so the answer is 1,"), F.lpad(q, 3, "0"), F.lit(".")))
        .when(kind == 2, F.lit("No idea"))
        .when(kind == 3, F.concat(F.lit("It is "), thousand))
        .otherwise(F.concat(F.lit("The answer is "), q, F.lit(".7 dollars")))
    )
    answer = F.when(F.col("supp") % 6 == 0, F.lit("oops")).when(F.col("supp") % 6 == 1, thousand).when(
        F.col("supp") % 6 == 2, F.lit("0")
    ).otherwise(q)
    return _lines(spark, sf).select(
        "case_id", F.col("ordinal").alias("slot"), F.concat(F.lit("How many of "), q, F.lit("?")).alias("new_question"),
        answer.alias("new_answer"), prediction.alias("new_prediction"),
    )


SQL_VARIANTS = f"""{SQL_LINES},
va AS (SELECT case_id, ordinal AS slot, 'How many of ' || q || '?' AS new_question,
  CASE supp % 6 WHEN 0 THEN 'oops' WHEN 1 THEN CAST(q + 1000 AS VARCHAR) WHEN 2 THEN '0' ELSE CAST(q AS VARCHAR) END AS new_answer,
  CASE part % 5 WHEN 0 THEN 'The answer is ' || q || '.' WHEN 1 THEN 'Then 3 + 4, so the answer is 1,' || lpad(CAST(q AS VARCHAR), 3, '0') || '.'
       WHEN 2 THEN 'No idea' WHEN 3 THEN 'It is ' || (q + 1000) ELSE 'The answer is ' || q || '.7 dollars' END AS new_prediction FROM lines_)"""


@query("last_number", f"""WITH {SQL_VARIANTS}
SELECT case_id, slot, {sql_last_number('new_prediction')} AS found, coalesce({sql_last_number('new_prediction')}, -50000000000.0) AS with_default FROM va""")
def last_number_query(spark, sf):
    return _variants(spark, sf).select(
        "case_id", "slot", last_number("new_prediction").alias("found"), last_number("new_prediction", S.NO_NUMBER).alias("with_default")
    )


SQL_ACCEPT = f"coalesce(CAST(trunc({sql_last_number('new_prediction')}) AS BIGINT) = CAST(trunc({sql_float('new_answer')}) AS BIGINT), false)"


@query("verify_variants", f"WITH {SQL_VARIANTS} SELECT * FROM va WHERE {SQL_ACCEPT}")
def verify_variants(spark, sf):
    return S.verify_variants(_variants(spark, sf))


@query("generation_quota", f"""WITH {SQL_VARIANTS},
n AS (SELECT o_custkey AS case_id, count(slot) FILTER ({SQL_ACCEPT}) AS n_accepted FROM orders LEFT JOIN va ON va.case_id = o_orderkey GROUP BY o_custkey)
SELECT case_id, n_accepted, CAST(n_accepted >= 20 AS INTEGER) AS complete FROM n""")
def generation_quota(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer"))
    accepted = S.verify_variants(_variants(spark, sf)).join(orders, "case_id").select(F.col("customer").alias("case_id"))
    customers = orders.select(F.col("customer").alias("case_id")).distinct()
    done = S.generation_quota(accepted, customers)
    return done.withColumn("complete", F.col("complete").cast("int"))


ROUND_QUOTA = 3


@query("quota_rounds", f"""WITH {SQL_VARIANTS},
ok AS (SELECT case_id, slot, slot % 2 AS round FROM va WHERE {SQL_ACCEPT}),
first_round AS (SELECT case_id, count(*) AS n FROM ok WHERE round = 0 GROUP BY case_id),
kept AS (SELECT ok.case_id FROM ok LEFT JOIN first_round f USING (case_id) WHERE round = 0 OR coalesce(f.n, 0) < {ROUND_QUOTA})
SELECT o_orderkey AS case_id, count(kept.case_id) AS n_accepted, {ROUND_QUOTA} - count(kept.case_id) AS n_wanted
FROM orders LEFT JOIN kept ON kept.case_id = o_orderkey GROUP BY o_orderkey HAVING count(kept.case_id) < {ROUND_QUOTA}""")
def quota_rounds(spark, sf):
    """Two rounds of variants; what is still to be asked of whom after them."""
    variants = stage(_variants(spark, sf), "variants")
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    accepted = variants.select("case_id", "slot").limit(0)
    for number in range(2):
        accepted, still_open = S.quota_round(accepted, variants.where(F.col("slot") % 2 == number), cases, ROUND_QUOTA)
        accepted = stage(accepted, "accepted")
    return still_open.select("case_id", "n_accepted", (F.lit(ROUND_QUOTA) - F.col("n_accepted")).alias("n_wanted"))


def _slots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, predictions and answers by (case_id, slot); the last slot has no prediction."""
    variants = stage(_variants(spark, sf), "variants")  # three tables come from it
    last = variants.groupBy("case_id").agg(F.max("slot").alias("last"))
    predictions = variants.join(last, "case_id").where("slot < last")
    return (
        variants.select("case_id", "slot", "new_question"),
        predictions.select("case_id", "slot", "new_prediction"),
        variants.select("case_id", "slot", "new_answer"),
    )


SQL_SHORT = f"{SQL_VARIANTS}, sized AS (SELECT *, max(slot) OVER (PARTITION BY case_id) AS last_slot FROM va)"


@query("align_variants", f"""WITH {SQL_SHORT}
SELECT case_id, slot, new_question, new_prediction, new_answer FROM sized WHERE slot < last_slot""")
def align_variants(spark, sf):
    return S.align_slots(*_slots(spark, sf))


@query("select_retries", f"""WITH {SQL_SHORT},
many AS (SELECT DISTINCT case_id FROM sized WHERE slot < last_slot AND case_id % 4 <> 0),
z AS (SELECT case_id, slot, new_question AS question, new_answer, CASE WHEN m.case_id IS NULL THEN '-50000000' ELSE new_prediction END AS p
      FROM sized LEFT JOIN many m USING (case_id) WHERE m.case_id IS NULL OR slot < last_slot)
SELECT case_id, slot, question FROM z
WHERE NOT coalesce(CAST(trunc(coalesce({sql_last_number('p')}, -50000000000.0)) AS BIGINT) = CAST(trunc({sql_float('new_answer')}) AS BIGINT), false)""")
def select_retries(spark, sf):
    questions, predictions, answers = _slots(spark, sf)
    return S.select_retries(questions, predictions.where("case_id % 4 <> 0"), answers)


@query("join_responses", f"""WITH {SQL_CASES}
SELECT case_id AS prompt_id, question, coalesce(program, '') AS response FROM cases
LEFT JOIN (SELECT l_orderkey, 'line ' || max(l_linenumber) AS program FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) < 6) r ON r.l_orderkey = case_id""")
def join_responses(spark, sf):
    prompts = _cases(spark, sf).select(F.col("case_id").alias("prompt_id"), "question")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("prompt_id")).agg(F.max("l_linenumber").alias("n"))
    responses = lines.where("n < 6").select("prompt_id", F.concat(F.lit("line "), F.col("n").cast("string")).alias("response"))
    return S.join_responses(prompts, responses)


@query("merge_retries", f"""WITH {SQL_VARIANTS}
SELECT case_id, slot, CASE WHEN NOT {SQL_ACCEPT} AND slot % 2 = 0 THEN 'again ' || new_answer WHEN case_id % 9 = 0 THEN '' ELSE new_prediction END AS new_prediction FROM va""")
def merge_retries(spark, sf):
    variants = stage(_variants(spark, sf), "variants")
    wrong = variants.join(S.verify_variants(variants).select("case_id", "slot"), ["case_id", "slot"], "left_anti")
    retried = wrong.where("slot % 2 = 0").select("case_id", "slot", F.concat(F.lit("again "), "new_answer").alias("response"))
    held = variants.select(
        "case_id", "slot", F.when(F.col("case_id") % 9 != 0, F.col("new_prediction")).alias("new_prediction")
    )
    return S.merge_retries(held, retried)


SQL_PARSED = r"""parsed AS (SELECT case_id, slot, regexp_replace(regexp_replace(CASE WHEN contains(new_prediction, 'answer is') THEN trim(string_split(new_prediction, 'answer is')[-1])
   ELSE string_split(new_prediction, ' ')[-1] END, '\.$', ''), '[^\d.]', '', 'g') AS answer FROM va)"""


@query("parse_answer", f"WITH {SQL_VARIANTS}, {SQL_PARSED} SELECT case_id, slot, answer FROM parsed")
def parse_answer(spark, sf):
    return _variants(spark, sf).select("case_id", "slot", S.parse_answer(F.col("new_prediction")).alias("answer"))


@query("majority_answer", f"""WITH {SQL_VARIANTS}, {SQL_PARSED}
SELECT case_id, answer, count(*) AS votes FROM parsed GROUP BY case_id, answer
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, min(slot)) = 1""")
def majority_answer(spark, sf):
    answers = _variants(spark, sf).select("case_id", F.col("slot").alias("pos"), F.col("new_prediction").alias("response"))
    return S.majority_answer(answers)


OUTER, INNER = 30, 5  # as many rounds as the original's


@query("iterative_rounds", f"""WITH RECURSIVE {SQL_RESPONSES.replace("WITH ", "")},
{SQL_PROGRAMS[len(SQL_CASES) + 2:]}, {SQL_GOLD},
tries AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ordinal) - 1 AS t, program,
                 coalesce(r = g, false) AND NOT contains(program, 'while True:') AS hit FROM res),
first_hit AS (SELECT case_id, min(t) AS t FROM tries WHERE hit AND t < {OUTER * INNER} GROUP BY case_id),
ended AS (SELECT case_id, coalesce(t, {OUTER * INNER - 1}) AS t, t IS NOT NULL AS solved FROM cases LEFT JOIN first_hit USING (case_id))
SELECT e.case_id, e.t AS round, CAST(solved AS INTEGER) AS solved, e.t % {INNER} + 1 AS n_programs,
       CASE WHEN solved THEN 100.0::DOUBLE / (e.t % {INNER} + 1) ELSE 0 END AS correct, e.t // {INNER} AS n_prev,
       md5(masked) AS masked_md5, CASE WHEN c.case_id % 5 = 0 THEN '' ELSE parameters END AS parameters, md5(coalesce(p.program, '')) AS program_md5
FROM ended e JOIN cases c USING (case_id) JOIN m1 USING (case_id) LEFT JOIN tries p ON p.case_id = e.case_id AND p.t = e.t""")
def iterative_rounds(spark, sf):
    """The cycle over orders; what a model and a program runner would say is told from the order and its lines."""
    cases = stage(_cases(spark, sf), "cases")
    turn = F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal")).cast("bigint") - 1  # an order has a few lines
    told = stage(_programs(spark, sf).select("case_id", turn.alias("turn"), "response", "result"), "told", partition_by=("turn",))
    numbers = cases.select("case_id", "q", "price", "parameters")  # a response is told where its case is known to be asked

    def model(kind: str, number: int, prompts: DataFrame) -> DataFrame:
        asked = prompts.select("case_id")
        if kind == "mask":
            return asked.join(numbers, "case_id").select("case_id", _masking_response().alias("response"))
        return asked.join(told.where(F.col("turn") == number).select("case_id", "response"), "case_id")

    def runner(number: int, calls: DataFrame) -> DataFrame:
        return calls.select("case_id").join(told.where(F.col("turn") == number).select("case_id", "result"), "case_id")

    log = CommitLog(spark, fresh_path(spark, "cycle"))
    found = cycle.solve_cases(cases.select("case_id", "question", "answer"), log, model, runner, OUTER, INNER, SEED)
    return found.select(
        "case_id", "round", F.col("solved").cast("int").alias("solved"), F.size("programs").cast("bigint").alias("n_programs"), "correct",
        F.size("prev").cast("bigint").alias("n_prev"), F.md5("masked_question").alias("masked_md5"), "parameters",
        F.md5(F.element_at("programs", -1)).alias("program_md5"),
    )


# --- case selection --------------------------------------------------------------------


ARCHIVED = ("masked_question", "replacement", "parameters", "program", "result", "correct")


@query("select_unsolved", f"""WITH {SQL_CASES}
SELECT case_id, CAST(1 AS BIGINT) AS n_prev, 'masked ' || case_id AS prev_masked, 'replaced ' || case_id AS prev_replacement,
       parameters AS prev_parameters, 'program ' || case_id AS prev_program, 'result ' || case_id AS prev_result, correct AS prev_correct, CAST(6 AS BIGINT) AS n_cleared
FROM cases WHERE coalesce(correct, 0) <= 0""")
def select_unsolved(spark, sf):
    cases = _cases(spark, sf).select("case_id", "question", "parameters", "correct")
    made = {"masked_question": "masked ", "replacement": "replaced ", "program": "program ", "result": "result "}
    cases = cases.withColumns({n: F.concat(F.lit(t), F.col("case_id").cast("string")) for n, t in made.items()})
    kinds = ",".join(f"{n}:{'double' if n == 'correct' else 'string'}" for n in ARCHIVED)
    redone = quality.select_unsolved(cases.withColumn("prev", F.array().cast(f"array<struct<{kinds}>>")), list(ARCHIVED), rework=True)
    before = F.col("prev")[0]
    return redone.select(
        "case_id", F.size("prev").cast("bigint").alias("n_prev"), before["masked_question"].alias("prev_masked"),
        before["replacement"].alias("prev_replacement"), before["parameters"].alias("prev_parameters"), before["program"].alias("prev_program"),
        before["result"].alias("prev_result"), before["correct"].alias("prev_correct"),
        sum((F.col(n).isNull().cast("bigint") for n in ARCHIVED), F.lit(0)).cast("bigint").alias("n_cleared"),
    )


EXCLUDED = [306]  # fixed value: cases known to hang


@query("select_usable_cases", f"""
SELECT o_orderkey AS case_id, count(*) AS n_programs FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey NOT IN ({EXCLUDED[0]}) GROUP BY o_orderkey""")
def select_usable_cases(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    candidates = _lines(spark, sf)
    excluded = spark.createDataFrame([(c,) for c in EXCLUDED], "case_id bigint")
    usable = quality.select_usable_cases(orders, excluded, candidates)
    programs = candidates.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_programs"))
    return usable.join(programs, "case_id")
