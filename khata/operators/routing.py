"""Question classes, intents and retrieval query expansion over a text column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import any_of, captured, contains_any, first_match_index, found, matches_any, strip


def classify_questions(df: DataFrame, question: str) -> DataFrame:
    """Add ``question_class``, ``confidence``, ``entity`` and ``answer_source``.

    The classes are tried in a fixed order: own data, rate, code, law, definition,
    then looser word tests.
    """
    q = strip(F.lower(F.col(question)))

    def phrase(patterns, words):
        return F.nullif(captured(F.col("_q"), patterns, words), F.lit(""))

    work = df.withColumn("_q", q).withColumns({
        "_rate": phrase(fv.RATE_QUESTION_PATTERNS, fv.RATE_QUESTION_WORDS),
        "_code": phrase(fv.CODE_QUESTION_PATTERNS, fv.CODE_QUESTION_WORDS),
        "_term": phrase(fv.DEFINITION_QUESTION_PATTERNS, fv.DEFINITION_QUESTION_WORDS)})
    q = F.col("_q")
    legal = any_of(found(q, q, fv.LEGAL_QUESTION_PATTERNS, fv.LEGAL_QUESTION_WORDS))

    def row(name, confidence, source, entity=None):
        return F.struct(F.lit(name).alias("question_class"), confidence.cast("double").alias("confidence"),
                        (entity if entity is not None else F.lit(None).cast("string")).alias("entity"),
                        F.lit(source).alias("answer_source"))

    known = F.when(contains_any(F.col("_term"), fv.ITC_CONCEPTS), 0.9).otherwise(0.7)
    out = (F.when(matches_any(q, fv.DATA_QUESTION_PATTERNS), row("data_query", F.lit(0.9), fv.SOURCE_OF_DATA))
            .when(F.col("_rate").isNotNull(), row("rate_lookup", F.lit(0.85), fv.SOURCE_OF_RATES, F.col("_rate")))
            .when(F.col("_code").isNotNull(), row("hsn_sac_lookup", F.lit(0.85), fv.SOURCE_OF_RATES, F.col("_code")))
            .when(legal, row("legal_rule", F.lit(0.8), fv.SOURCE_OF_RULES))
            .when(F.col("_term").isNotNull(), row("definition", known, fv.SOURCE_OF_TERMS, F.col("_term")))
            .when(contains_any(q, fv.ITC_CONCEPTS), row("definition", F.lit(0.6), fv.SOURCE_OF_TERMS))
            .when(contains_any(q, fv.TAX_WORDS), row("general", F.lit(0.5), fv.SOURCE_OF_RULES))
            .otherwise(row("general", F.lit(0.4), fv.SOURCE_OF_TERMS)))
    return work.withColumn("_c", out).select(*df.columns, "_c.*")


def looks_like_path(text: Column) -> Column:
    head = F.split(text, "/", 2)[0]
    return (text.startswith("/") | text.startswith("~") | text.startswith("./") | text.startswith("../")
            | text.contains(":\\") | (text.contains("/") & ~head.contains(" ")))


def route_intents(df: DataFrame, text: str) -> DataFrame:
    """Add ``intent``, ``confidence``, ``intent_path`` and ``intent_query``."""
    t = strip(F.col(text))
    flat = [(name, p) for name, patterns in fv.INTENT_PATTERNS for p in patterns]
    work = df.withColumn("_t", t).withColumn("_low", F.lower("_t"))
    t, low = F.col("_t"), F.col("_low")
    work = work.withColumn("_i", first_match_index(t, low, [p for _, p in flat], fv.INTENT_PATTERN_WORDS))

    names = F.array(*[F.lit(name) for name, _ in flat])
    groups = None
    for i, (_, p) in enumerate(flat):
        if re.compile(p).groups:
            hit, value = F.col("_i") == i, F.regexp_extract(t, f"(?i){p}", 1)
            groups = F.when(hit, value) if groups is None else groups.when(hit, value)
    missing = F.lit(None).cast("string")

    def row(intent, confidence, path=missing, query=t):
        intent = intent if isinstance(intent, Column) else F.lit(intent)
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(intent.alias("intent"), confidence.cast("double").alias("confidence"),
                        path.alias("intent_path"), query.alias("intent_query"))

    matched = F.element_at(names, F.col("_i") + 1)
    folder = matched == "folder_analysis"
    out = (F.when(t == "", row("unknown", 0.0, query=missing))
            .when(looks_like_path(t), row("folder_analysis", 0.9, t, missing))
            .when(F.col("_i").isNotNull(), row(
                matched, F.when(folder, 0.85).otherwise(0.8), F.when(folder, F.col("_g")),
                F.when(~folder, F.coalesce(F.nullif(F.col("_g"), F.lit("")), t))))
            .when(contains_any(low, fv.INTENT_DATA_WORDS), row("data_query", 0.7))
            .when(contains_any(low, fv.INTENT_OWN_WORDS), row("data_query", 0.6))
            .when(contains_any(low, fv.INTENT_EXPLAIN_WORDS + fv.INTENT_WHAT_WORDS), row("knowledge_query", 0.6))
            .when(contains_any(low, fv.INTENT_TAX_WORDS), row("knowledge_query", 0.5))
            .when(t.endswith("?"), row("data_query", 0.4))
            .otherwise(row("unknown", 0.3)))
    return work.withColumn("_g", groups).withColumn("_r", out).select(*df.columns, "_r.*")


def expand_query(query: Column) -> Column:
    """Append the fixed terms of every trigger group found in the query."""
    low = F.lower(query)
    return F.concat_ws(" ", query, *[F.when(contains_any(low, words), F.lit(terms)) for words, terms in fv.QUERY_EXPANSIONS])
