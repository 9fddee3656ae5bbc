"""Question routing and screening of prompts, SQL texts, paths and answers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions import text as tx
from khata.operators import routing, screening
from khata.plans import standins as st
from khata.plans.duck import any_contains, any_match, lit, strip
from khata.plans.registry import query
from khata.session import spread


def _capture(column, patterns):
    body = " ".join(f"WHEN regexp_matches({column}, {lit(p)}, 'i') THEN trim(regexp_extract({column}, {lit(p)}, 1, 'i'))"
                    for p in patterns)
    return f"nullif(CASE {body} END, '')"


_CLASSES = f"""
WITH q AS (SELECT question_id, {strip("lower(question)")} AS q FROM ({st.duck(st.QUESTIONS_SQL)})),
facts AS (
  SELECT *, {any_match("q", fv.DATA_QUESTION_PATTERNS)} AS is_data, {_capture("q", fv.RATE_QUESTION_PATTERNS)} AS rate,
         {_capture("q", fv.CODE_QUESTION_PATTERNS)} AS code, {any_match("q", fv.LEGAL_QUESTION_PATTERNS)} AS is_legal,
         {_capture("q", fv.DEFINITION_QUESTION_PATTERNS)} AS term, {any_contains("q", fv.ITC_CONCEPTS)} AS has_concept,
         {any_contains("q", fv.TAX_WORDS)} AS has_tax FROM q)
"""


@query("c1_question_class", _CLASSES + f"""
SELECT question_id,
  CASE WHEN is_data THEN 'data_query' WHEN rate IS NOT NULL THEN 'rate_lookup' WHEN code IS NOT NULL THEN 'hsn_sac_lookup'
       WHEN is_legal THEN 'legal_rule' WHEN term IS NOT NULL OR has_concept THEN 'definition' ELSE 'general' END AS question_class,
  CAST(CASE WHEN is_data THEN 0.9 WHEN rate IS NOT NULL OR code IS NOT NULL THEN 0.85 WHEN is_legal THEN 0.8
       WHEN term IS NOT NULL THEN CASE WHEN {any_contains("term", fv.ITC_CONCEPTS)} THEN 0.9 ELSE 0.7 END
       WHEN has_concept THEN 0.6 WHEN has_tax THEN 0.5 ELSE 0.4 END AS DOUBLE) AS confidence,
  CASE WHEN is_data THEN 'duckdb' WHEN rate IS NOT NULL OR code IS NOT NULL THEN 'csv' WHEN is_legal THEN 'chromadb'
       WHEN term IS NOT NULL OR has_concept THEN 'llm' WHEN has_tax THEN 'chromadb' ELSE 'llm' END AS answer_source
FROM facts
""")
def c1_question_class(spark, d):
    return routing.classify_questions(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question").drop("question", "entity")


@query("c2_matched_phrase", _CLASSES + """
SELECT question_id, CASE WHEN is_data THEN NULL WHEN rate IS NOT NULL THEN rate WHEN code IS NOT NULL THEN code
  WHEN is_legal THEN NULL ELSE term END AS entity FROM facts
""")
def c2_matched_phrase(spark, d):
    return routing.classify_questions(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question").select("question_id", "entity")


_FLAT = [(name, p) for name, patterns in fv.INTENT_PATTERNS for p in patterns]
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(t, {lit(p)}, 'i') THEN {i}" for i, (_, p) in enumerate(_FLAT)) + " END"
_GROUP = "CASE i " + " ".join(f"WHEN {i} THEN regexp_extract(t, {lit(p)}, 1, 'i')" for i, (_, p) in enumerate(_FLAT)
                              if re.compile(p).groups) + " END"
_NAMES = "[" + ", ".join(lit(n) for n, _ in _FLAT) + "]"
_PATH = ("(starts_with(t, '/') OR starts_with(t, '~') OR starts_with(t, './') OR starts_with(t, '../') OR contains(t, ':\\') "
         "OR (contains(t, '/') AND NOT contains(split_part(t, '/', 1), ' ')))")
_INTENTS = f"""
WITH q AS (SELECT question_id, {strip("question")} AS t FROM ({st.duck(st.QUESTIONS_SQL)})),
m AS (SELECT *, lower(t) AS low, {_PATH} AS is_path, {_FIRST} AS i FROM q),
g AS (SELECT *, {_NAMES}[i + 1] AS matched, {_GROUP} AS grp FROM m)
"""


@query("c3_intent", _INTENTS + f"""
SELECT question_id,
  CASE WHEN t = '' THEN 'unknown' WHEN is_path THEN 'folder_analysis' WHEN i IS NOT NULL THEN matched
       WHEN {any_contains("low", fv.INTENT_DATA_WORDS + fv.INTENT_OWN_WORDS)} THEN 'data_query'
       WHEN {any_contains("low", fv.INTENT_EXPLAIN_WORDS + fv.INTENT_WHAT_WORDS + fv.INTENT_TAX_WORDS)} THEN 'knowledge_query'
       WHEN ends_with(t, '?') THEN 'data_query' ELSE 'unknown' END AS intent,
  CAST(CASE WHEN t = '' THEN 0 WHEN is_path THEN 0.9 WHEN i IS NOT NULL THEN CASE WHEN matched = 'folder_analysis' THEN 0.85 ELSE 0.8 END
       WHEN {any_contains("low", fv.INTENT_DATA_WORDS)} THEN 0.7
       WHEN {any_contains("low", fv.INTENT_OWN_WORDS + fv.INTENT_EXPLAIN_WORDS + fv.INTENT_WHAT_WORDS)} THEN 0.6
       WHEN {any_contains("low", fv.INTENT_TAX_WORDS)} THEN 0.5 WHEN ends_with(t, '?') THEN 0.4 ELSE 0.3 END AS DOUBLE) AS confidence,
  CASE WHEN t = '' THEN NULL WHEN is_path THEN t WHEN matched = 'folder_analysis' THEN grp END AS intent_path,
  CASE WHEN t = '' OR is_path OR matched = 'folder_analysis' THEN NULL
       WHEN i IS NOT NULL THEN coalesce(nullif(grp, ''), t) ELSE t END AS intent_query
FROM g
""")
def c3_intent(spark, d):
    return routing.route_intents(spread(st.from_sql(spark, d, st.QUESTIONS_SQL)), "question").drop("question")


@query("c4_looks_like_path", f"""
SELECT question_id, {_PATH} AS is_path FROM (SELECT question_id, question AS t FROM ({st.duck(st.QUESTIONS_SQL)}))
UNION ALL SELECT concat('u', CAST(path_id AS VARCHAR)), {_PATH} FROM (SELECT path_id, path AS t FROM ({st.duck(st.PATHS_SQL)}))
""")
def c4_looks_like_path(spark, d):
    questions = spread(st.from_sql(spark, d, st.QUESTIONS_SQL)).select("question_id", F.col("question").alias("t"))
    paths = st.from_sql(spark, d, st.PATHS_SQL).select(F.concat(F.lit("u"), F.col("path_id")).alias("question_id"),
                                                       F.col("path").alias("t"))
    return questions.unionByName(paths).select("question_id", routing.looks_like_path(F.col("t")).alias("is_path"))


@query("k6_expanded_query", f"""
SELECT question_id, concat_ws(' ', question, {", ".join(
    f"CASE WHEN {any_contains('lower(question)', words)} THEN {lit(terms)} END" for words, terms in fv.QUERY_EXPANSIONS)}) AS expanded
FROM ({st.duck(st.QUESTIONS_SQL)})
""")
def k6_expanded_query(spark, d):
    return spread(st.from_sql(spark, d, st.QUESTIONS_SQL)).select("question_id", routing.expand_query(F.col("question")).alias("expanded"))


def _count(column, patterns):
    return " + ".join(f"len(regexp_extract_all({column}, {lit('(?im)' + p)}))" for p in patterns)


def _hits(column, label, patterns, shown=50, flags="(?im)"):
    items = ", ".join(f"CASE WHEN regexp_matches({column}, {lit(flags + p)}) THEN {lit(label + ': ' + p[:shown])} END" for p in patterns)
    return f"list_filter([{items}], lambda r: r IS NOT NULL)"


_SCREEN = f"""
WITH p AS (SELECT * FROM ({st.duck(st.PROMPTS_SQL)})),
hits AS (
  SELECT prompt_id, prompt, {_count("prompt", fv.ENCODING_PATTERNS)} AS encoded,
    {_hits("prompt", "System override attempt", fv.OVERRIDE_PATTERNS)} AS overrides,
    {_hits("prompt", "Prompt leak attempt", fv.LEAK_PATTERNS)} AS leaks,
    {_hits("prompt", "Delimiter injection", fv.DELIMITER_PATTERNS)} AS delimiters,
    {_hits("prompt", "Context manipulation", fv.CONTEXT_PATTERNS)} AS contexts FROM p),
levels AS (
  SELECT *, CASE WHEN len(overrides) > 0 THEN 'critical' WHEN len(leaks) > 0 OR len(delimiters) > 0 THEN 'high'
                 WHEN encoded > 3 OR len(contexts) > 0 THEN 'medium' WHEN length(prompt) > 5000 THEN 'low' ELSE 'none' END AS threat_level FROM hits)
"""


@query("c5_prompt_screen", _SCREEN + """
SELECT prompt_id, threat_level, threat_level IN ('high', 'critical') AS blocked, threat_level = 'none' AS is_safe,
  array_to_string(list_concat(
    CASE WHEN length(prompt) > 5000 THEN [concat('Input too long (', length(prompt), ' > 5000)')] ELSE [] END,
    overrides, leaks, delimiters,
    CASE WHEN encoded > 3 THEN [concat('Suspicious encoding (', encoded, ' patterns)')] ELSE [] END, contexts), '; ') AS threats
FROM levels
""")
def c5_prompt_screen(spark, d):
    out = screening.screen_prompts(spread(st.from_sql(spark, d, st.PROMPTS_SQL)), "prompt")
    return out.select("prompt_id", "threat_level", "blocked", "is_safe", F.array_join("threats", "; ").alias("threats"))


@query("c5_threat_levels", _SCREEN + "SELECT threat_level, count(*) AS prompts FROM levels GROUP BY 1")
def c5_threat_levels(spark, d):
    levels = screening.threat_levels(spread(st.from_sql(spark, d, st.PROMPTS_SQL)), "prompt")
    return levels.groupBy("threat_level").agg(F.count(F.lit(1)).alias("prompts"))


@query("c6_clean_prompt", f"""
SELECT prompt_id, regexp_replace(trim(regexp_replace(regexp_replace(prompt, {lit("|".join(fv.REMOVED_DELIMITERS))}, '', 'gi'),
         '\\s+', ' ', 'g')), '```[\\s\\S]*?```', '[code removed]', 'g') AS sanitized
FROM ({st.duck(st.PROMPTS_SQL)})
""")
def c6_clean_prompt(spark, d):
    return spread(st.from_sql(spark, d, st.PROMPTS_SQL)).select("prompt_id", screening.clean_prompt(F.col("prompt")).alias("sanitized"))


_DANGERS = ", ".join(
    f"CASE WHEN regexp_matches(s1, {lit('(?i)' + p)}) THEN concat('Dangerous SQL pattern detected: ', regexp_extract(s1, {lit('(?i)' + p)}, 0)) END"
    for p in fv.SQL_DANGER_PATTERNS)


@query("c7_sql_screen", f"""
WITH s AS (SELECT text_id, {strip("sql_text")} AS s0 FROM ({st.duck(st.SQL_TEXTS_SQL)})),
parts AS (SELECT *, list_filter(list_transform(string_split(s0, ';'), lambda x: {strip("x")}), lambda x: x <> '') AS parts FROM s),
one AS (SELECT *, CASE WHEN len(parts) > 1 THEN parts[1] ELSE s0 END AS s1 FROM parts),
facts AS (
  SELECT *, len(parts) > 1 AS stacked, starts_with(upper(s1), 'SELECT') OR starts_with(upper(s1), 'WITH') AS reads,
         list_filter([{_DANGERS}], lambda r: r IS NOT NULL) AS dangers, regexp_matches(s1, '--\\s*$') AS dashed,
         {strip("regexp_replace(s1, '--\\s*$', '')")} AS s2 FROM one)
SELECT text_id,
  coalesce(s0 <> '' AND length(s0) <= 10000 AND reads AND NOT stacked AND len(dangers) = 0 AND NOT dashed, false) AS is_valid,
  CASE WHEN s0 = '' THEN '' WHEN length(s0) > 10000 THEN s0 WHEN NOT reads THEN s1
       ELSE {strip("CASE WHEN contains(s2, '/*') THEN regexp_replace(s2, '/\\*.*?\\*/', '', 'gs') ELSE s2 END")} END AS clean,
  CASE WHEN s0 = '' THEN 'Empty SQL query'
       WHEN length(s0) > 10000 THEN concat('Query too long (', length(s0), ' > 10000)')
       ELSE array_to_string(list_concat(
         CASE WHEN stacked THEN ['Multiple statements detected (potential stacked query injection)'] ELSE [] END,
         CASE WHEN NOT reads THEN ['Query must start with SELECT or WITH'] ELSE list_concat(dangers,
           CASE WHEN dashed THEN ['Trailing comment detected'] ELSE [] END,
           CASE WHEN contains(s2, '/*') THEN ['Block comment detected and removed'] ELSE [] END) END), '; ') END AS issues
FROM facts
""")
def c7_sql_screen(spark, d):
    checked = screening.screen_sql(spread(st.from_sql(spark, d, st.SQL_TEXTS_SQL)), "sql_text")
    return checked.select("text_id", "is_valid", "clean", F.array_join("issues", "; ").alias("issues"))


_NORMAL = """
  list_reduce(string_split(path, '/'), lambda acc, x: CASE
    WHEN x = '' OR x = '.' THEN acc
    WHEN x = '..' THEN CASE WHEN acc = '' THEN CASE WHEN starts_with(path, '/') THEN '' ELSE '/..' END
                            WHEN ends_with(acc, '/..') THEN concat(acc, '/..') ELSE regexp_replace(acc, '/[^/]*$', '') END
    ELSE concat(acc, '/', x) END, '')
"""


@query("c8_path_screen", f"""
WITH p AS (SELECT path_id, path, {_NORMAL} AS n FROM ({st.duck(st.PATHS_SQL)})),
r AS (SELECT *, CASE WHEN regexp_matches(path, '^//($|[^/])') THEN concat('/', coalesce(nullif(n, ''), '/'))
                     WHEN starts_with(path, '/') THEN coalesce(nullif(n, ''), '/')
                     WHEN n = '' THEN '.' ELSE substr(n, 2) END AS resolved,
             {_hits("path", "Path traversal pattern detected", fv.PATH_TRAVERSAL_PATTERNS, 30, "(?i)")} AS hits FROM p)
SELECT path_id, resolved, len(hits) = 0 AND (starts_with(resolved, 'workspace/acme') OR starts_with(resolved, 'a/b')) AS is_valid,
  array_to_string(list_concat(hits, CASE WHEN starts_with(resolved, 'workspace/acme') OR starts_with(resolved, 'a/b') THEN []
                                         ELSE ['Path outside allowed directories'] END), '; ') AS issues
FROM r
""")
def c8_path_screen(spark, d):
    checked = st.from_sql(spark, d, st.PATHS_SQL).select(
        "path_id", screening.check_path(F.col("path"), allowed=["workspace/acme", "a/b"]).alias("v"))
    return checked.select("path_id", "v.resolved", "v.is_valid", F.array_join("v.issues", "; ").alias("issues"))


@query("c9_escaped_output", f"""
SELECT prompt_id, replace(replace(replace(replace(replace(prompt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
       substr(CAST(to_json(prompt) AS VARCHAR), 2, length(CAST(to_json(prompt) AS VARCHAR)) - 2) AS json
FROM ({st.duck(st.PROMPTS_SQL)})
""")
def c9_escaped_output(spark, d):
    return spread(st.from_sql(spark, d, st.PROMPTS_SQL)).select(
        "prompt_id", tx.html_escape(F.col("prompt")).alias("html"), tx.json_escape(F.col("prompt")).alias("json"))


# RE2 has no look-ahead: sections are split at the marks instead
@query("c9_without_artifacts", f"""
WITH a AS (SELECT prompt_id, regexp_replace(regexp_replace(regexp_replace(prompt, '<\\|.*?\\|>', '', 'gis'), '\\[INST\\].*?\\[/INST\\]', '', 'gis'),
                  '<<SYS>>.*?<</SYS>>', '', 'gis') AS t FROM ({st.duck(st.PROMPTS_SQL)})),
p AS (SELECT prompt_id, string_split(t, '###') AS parts FROM a)
SELECT prompt_id, {strip("concat(parts[1], array_to_string(list_transform(list_filter(parts[2:], lambda x: NOT regexp_matches(x, '^\\s*(system|human|assistant)\\s*:', 'is')), lambda x: concat('###', x)), ''))")} AS clean FROM p
""")
def c9_without_artifacts(spark, d):
    return spread(st.from_sql(spark, d, st.PROMPTS_SQL)).select(
        "prompt_id", screening.without_artifacts(F.col("prompt")).alias("clean"))


def _cut(column, prefix):
    return f"CASE WHEN starts_with(lower({column}), '{prefix}') THEN {strip(f'substr({column}, {len(prefix) + 1})')} ELSE {column} END"


@query("c10_clean_sql", f"""
WITH s AS (SELECT text_id, {strip("sql_text")} AS s FROM ({st.duck(st.SQL_TEXTS_SQL)})),
a AS (SELECT text_id, CASE WHEN starts_with(s, '```') THEN {strip("array_to_string(list_filter(string_split(s, chr(10)), lambda l: NOT starts_with(l, '```')), chr(10))")} ELSE s END AS s FROM s),
b AS (SELECT text_id, {_cut("s", "sql")} AS s FROM a), c AS (SELECT text_id, {_cut("s", "sql")} AS s FROM b),
e AS (SELECT text_id, {_cut("s", "duckdb")} AS s FROM c), f AS (SELECT text_id, {_cut("s", "duckdb")} AS s FROM e)
SELECT text_id, {strip("split_part(" + strip("trim(s, '`')") + ", ';', 1)")} AS clean FROM f
""")
def c10_clean_sql(spark, d):
    return st.from_sql(spark, d, st.SQL_TEXTS_SQL).select("text_id", screening.clean_sql(F.col("sql_text")).alias("clean"))


@query("c11_strict_sql", f"""
SELECT text_id, (starts_with({strip("upper(sql_text)")}, 'SELECT') OR starts_with({strip("upper(sql_text)")}, 'WITH'))
  AND NOT {any_contains("upper(sql_text)", fv.STRICT_SQL_WORDS)}
  AND (NOT contains(sql_text, ';') OR (len(string_split(sql_text, ';')) = 2 AND ends_with(sql_text, ';'))) AS accepted
FROM ({st.duck(st.SQL_TEXTS_SQL)})
""")
def c11_strict_sql(spark, d):
    return st.from_sql(spark, d, st.SQL_TEXTS_SQL).select("text_id", screening.strict_sql(F.col("sql_text")).alias("accepted"))


def _replaced(column, fragments):
    for f in fragments:
        column = f"replace({column}, {lit(f)}, '')"
    return column


@query("c12_without_fragments", f"""
SELECT answer_id, {strip(_replaced("answer", fv.PROMPT_FRAGMENTS))} AS clean FROM ({st.duck(st.ANSWERS_SQL)})
""")
def c12_without_fragments(spark, d):
    return st.from_sql(spark, d, st.ANSWERS_SQL).select(
        "answer_id", screening.without_prompt_fragments(F.col("answer")).alias("clean"))


@query("c13_json_object", f"""
SELECT event_id, nullif(regexp_extract(reply, '\\{{.*\\}}', 0, 's'), '') AS object,
       CAST(json_extract(nullif(regexp_extract(reply, '\\{{.*\\}}', 0, 's'), ''), '$.k') AS BIGINT) AS k
FROM ({st.duck(st.JSON_REPLY_SQL)})
""")
def c13_json_object(spark, d):
    out = st.from_sql(spark, d, st.JSON_REPLY_SQL).select("event_id", screening.json_object(F.col("reply")).alias("object"))
    return out.withColumn("k", F.from_json("object", "k BIGINT")["k"])
