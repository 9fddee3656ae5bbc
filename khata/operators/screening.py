"""Screening and clean-up of text, SQL and path columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import any_of, contains_any, found, has_word, matches_any, strip
from khata.operators import sql_reads

LEVELS = ["none", "low", "medium", "high", "critical"]


NONE = "array<string>"


def _reasons(label: str, patterns: list[str], tests: list[Column], shown: int = 50) -> Column:
    """Texts of the patterns found."""
    return F.array_compact(F.array(*[F.when(t, F.lit(f"{label}: {p[:shown]}")) for p, t in zip(patterns, tests)]))


def _encoded(text: Column, low: Column) -> Column:
    """How many encoded pieces the text has."""
    parts = [F.when(has_word(low, w), F.regexp_count(text, F.lit(f"(?im){p}"))).otherwise(0)
             for p, w in zip(fv.ENCODING_PATTERNS, fv.ENCODING_WORDS, strict=True)]
    return reduce(Column.__add__, parts)


def screen_prompts(df: DataFrame, prompt: str, custom: list[str] | None = None,
                   max_chars: int = fv.PROMPT_MAX_CHARS, block_from: str = "high") -> DataFrame:
    """Add ``threat_level``, ``threats``, ``is_safe``, ``blocked`` and ``sanitized``.

    A text beyond ``max_chars`` counts as a low threat; it is still screened whole.
    """
    text, low = F.col(prompt), F.col("_low")
    empty = F.array().cast(NONE)

    def group(label, patterns, words):
        return _reasons(label, patterns, found(text, low, patterns, words, "im"))

    groups = [
        (1, F.when(F.length(text) > max_chars, F.array(F.concat(
            F.lit("Input too long ("), F.length(text), F.lit(f" > {max_chars})")))).otherwise(empty)),
        (4, group("System override attempt", fv.OVERRIDE_PATTERNS, fv.OVERRIDE_WORDS)),
        (3, group("Prompt leak attempt", fv.LEAK_PATTERNS, fv.LEAK_WORDS)),
        (3, group("Delimiter injection", fv.DELIMITER_PATTERNS, fv.DELIMITER_WORDS)),
        (2, F.when(F.col("_encoded") > fv.ENCODING_ALLOWED, F.array(F.concat(
            F.lit("Suspicious encoding ("), F.col("_encoded"), F.lit(" patterns)")))).otherwise(empty)),
        (2, group("Context manipulation", fv.CONTEXT_PATTERNS, fv.CONTEXT_WORDS)),
    ]
    if custom:
        groups.append((2, _reasons("Custom pattern match", custom, [text.rlike(f"(?im){p}") for p in custom])))

    out = df.withColumn("_low", F.lower(text)).withColumn("_encoded", _encoded(text, low))
    out = out.withColumns({f"_g{i}": reasons for i, (_, reasons) in enumerate(groups)})
    rank = F.greatest(*[F.when(F.size(f"_g{i}") > 0, level).otherwise(0) for i, (level, _) in enumerate(groups)])
    names = F.array(*[F.lit(name) for name in LEVELS])
    return (out.withColumn("threats", F.concat(*[F.col(f"_g{i}") for i in range(len(groups))]))
               .withColumn("_rank", rank)
               .withColumn("threat_level", F.element_at(names, F.col("_rank") + 1))
               .withColumn("is_safe", F.size("threats") == 0)
               .withColumn("blocked", F.col("_rank") >= LEVELS.index(block_from))
               .withColumn("sanitized", clean_prompt(text))
               .drop("_low", "_encoded", "_rank", *[f"_g{i}" for i in range(len(groups))]))


def threat_levels(df: DataFrame, prompt: str) -> DataFrame:
    """Add only ``threat_level``: the first group that hits decides, no reasons are listed."""
    text, low = F.col(prompt), F.col("_low")

    def hit(patterns, words):
        return any_of(found(text, low, patterns, words, "im"))

    level = (F.when(hit(fv.OVERRIDE_PATTERNS, fv.OVERRIDE_WORDS), "critical")
              .when(hit(fv.LEAK_PATTERNS, fv.LEAK_WORDS) | hit(fv.DELIMITER_PATTERNS, fv.DELIMITER_WORDS), "high")
              .when((_encoded(text, low) > fv.ENCODING_ALLOWED) | hit(fv.CONTEXT_PATTERNS, fv.CONTEXT_WORDS), "medium")
              .when(F.length(text) > fv.PROMPT_MAX_CHARS, "low").otherwise("none"))
    return df.withColumn("_low", F.lower(text)).withColumn("threat_level", level).drop("_low")


def clean_prompt(text: Column, allow_code: bool = False) -> Column:
    """Known delimiters out, white space collapsed, code blocks replaced."""
    joined = "|".join(fv.REMOVED_DELIMITERS)
    out = F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i){joined}", ""), r"\s+", " "))
    return out if allow_code else F.regexp_replace(out, r"```[\s\S]*?```", "[code removed]")


# --- SQL texts -----------------------------------------------------------------------

def screen_sql(df: DataFrame, sql: str, max_chars: int = fv.SQL_MAX_CHARS) -> DataFrame:
    """Add ``is_valid``, ``clean`` and ``issues`` for read-only query texts, step by step."""
    text, whole, first, without = F.col(sql), F.col("_whole"), F.col("_first"), F.col("_without")
    parts = F.filter(F.transform(F.split(whole, ";"), strip), lambda s: s != "")
    stacked, dashed, reads = F.col("_stacked"), F.col("_dashed"), F.col("_reads")
    step = (df.withColumn("_whole", F.coalesce(strip(text), F.lit("")))
            .withColumn("_parts", F.when(whole.contains(";"), parts).otherwise(F.array(whole)))
            .withColumn("_stacked", F.size("_parts") > 1)
            .withColumn("_first", F.when(stacked, F.get("_parts", F.lit(0))).otherwise(whole))
            .withColumn("_long", F.length(whole) > max_chars)
            .withColumn("_reads", F.upper(F.substring(first, 1, 6)).startswith("SELECT")
                        | F.upper(F.substring(first, 1, 4)).startswith("WITH"))
            .withColumn("_dangers", F.when(~F.col("_long") & reads & matches_any(first, fv.SQL_DANGER_PATTERNS), F.array_compact(F.array(*[
                F.when(first.rlike(f"(?i){p}"), F.concat(F.lit("Dangerous SQL pattern detected: "),
                                                        F.regexp_extract(first, f"(?i){p}", 0)))
                for p in fv.SQL_DANGER_PATTERNS]))).otherwise(F.array().cast(NONE)))
            .withColumn("_dashed", first.rlike(r"--\s*$"))
            .withColumn("_without", F.when(dashed, strip(F.regexp_replace(first, r"--\s*$", ""))).otherwise(first))
            .withColumn("_block", without.contains("/*")))

    issues = F.array_compact(F.concat(
        F.array(F.when(stacked, F.lit("Multiple statements detected (potential stacked query injection)"))),
        F.when(~reads, F.array(F.lit("Query must start with SELECT or WITH"))).otherwise(F.concat(F.col("_dangers"), F.array(
            F.when(dashed, F.lit("Trailing comment detected")),
            F.when(F.col("_block"), F.lit("Block comment detected and removed")))))))
    out = (step.withColumn("is_valid", (whole != "") & ~F.col("_long") & reads & ~stacked & (F.size("_dangers") == 0) & ~dashed)
           .withColumn("clean", F.when((whole == "") | F.col("_long"), whole).when(~reads, first).otherwise(
               strip(F.when(F.col("_block"), F.regexp_replace(without, r"(?s)/\*.*?\*/", "")).otherwise(without))))
           .withColumn("issues", F.when(whole == "", F.array(F.lit("Empty SQL query")))
                       .when(F.col("_long"), F.array(F.concat(
                           F.lit("Query too long ("), F.length(whole), F.lit(f" > {max_chars})")))).otherwise(issues)))
    return out.select(*df.columns, "is_valid", "clean", "issues")


def clean_sql(text: Column) -> Column:
    """Query text out of an answer: no fence, language name, back-ticks or second statement."""
    out = strip(text)
    lines = F.filter(F.split(out, "\n"), lambda l: ~l.startswith("```"))
    out = F.when(out.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(out)
    for prefix in fv.SQL_LANGUAGE_PREFIXES:
        for _ in range(2):
            out = F.when(F.lower(out).startswith(prefix), strip(F.substr(out, F.lit(len(prefix) + 1)))).otherwise(out)
    out = strip(F.btrim(out, F.lit("`")))
    return strip(F.split(out, ";", 2)[0])


def strict_sql(text: Column) -> Column:
    """Stricter check: reads only, none of eight words even inside names, one statement at most."""
    up = F.upper(text)
    start = strip(up)
    semicolons = F.length(text) - F.length(F.replace(text, F.lit(";"), F.lit("")))
    return ((start.startswith("SELECT") | start.startswith("WITH"))
            & ~contains_any(up, fv.STRICT_SQL_WORDS)
            & ((semicolons == 0) | ((semicolons == 1) & text.endswith(";"))))


def guarded_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None,
                row_cap: int | None = None) -> DataFrame:
    """Run a query text only if :func:`screen_sql` passes it and it stays within ``tables``.

    ``tables`` are the frames the text may name in braces. Every other relation must be a common table expression of the
    text, and every function one of Spark's own: the parsed plan is searched for files, views and tables of the session,
    calls into the JVM and commands (:func:`sql_reads.foreign`). ``row_cap`` limits an answer that is meant for reading.
    """
    values = spark.sql("SELECT text FROM VALUES (:sql) AS given(text)", args={"sql": sql})  # folded without a job
    ok = screen_sql(values, "text").first()
    if not ok["is_valid"]:
        raise ValueError("; ".join(ok["issues"]))
    text = ok["clean"].rstrip(";")
    if issues := sql_reads.foreign(spark, text, tables or {}):
        raise ValueError("; ".join(issues))
    out = spark.sql(text, **(tables or {}))
    return out if row_cap is None else out.limit(row_cap)


# --- paths and answers ---------------------------------------------------------------

def normal_path(path: Column) -> Column:
    """POSIX normal form: no empty or ``.`` parts, ``..`` folded into its parent."""
    absolute = path.startswith("/")

    def step(acc, part):
        last = F.try_element_at(acc, F.lit(-1))
        up = (F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
               .when(absolute, acc).otherwise(F.concat(acc, F.array(part))))
        return (F.when((part == "") | (part == "."), acc).when(part == "..", up)
                 .otherwise(F.concat(acc, F.array(part))))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    lead = F.when(path.rlike("^//($|[^/])"), "//").when(absolute, "/").otherwise("")
    return F.when((lead == "") & (joined == ""), ".").otherwise(F.concat(lead, joined))


def check_path(path: Column, base: str | None = None, allowed: list[str] | None = None) -> Column:
    """Struct ``is_valid, resolved, issues``; ``allowed`` are normal base folders."""
    joined = path if base is None else F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), path))
    resolved = normal_path(joined)
    extra = [F.when(path.contains("\x00"), F.lit("Null byte in path"))]
    if allowed:
        inside = None
        for a in allowed:
            hit = resolved.startswith(a)
            inside = hit if inside is None else inside | hit
        extra.insert(0, F.when(~inside, F.lit("Path outside allowed directories")))
    tests = [path.rlike(f"(?i){p}") for p in fv.PATH_TRAVERSAL_PATTERNS]
    issues = F.concat(_reasons("Path traversal pattern detected", fv.PATH_TRAVERSAL_PATTERNS, tests, 30),
                      F.array_compact(F.array(*extra)))
    return F.struct((F.size(issues) == 0).alias("is_valid"), resolved.alias("resolved"), issues.alias("issues"))


def without_artifacts(text: Column) -> Column:
    """Control tokens and role sections out of an answer."""
    for p in fv.ARTIFACT_PATTERNS:
        text = F.regexp_replace(text, f"(?is){p}", "")
    return strip(text)


def without_prompt_fragments(answer: Column) -> Column:
    for fragment in fv.PROMPT_FRAGMENTS:
        answer = F.replace(answer, F.lit(fragment), F.lit(""))
    return strip(answer)


def json_object(text: Column) -> Column:
    """The text from the first to the last brace, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
