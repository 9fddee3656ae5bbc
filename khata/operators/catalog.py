"""Table profiles, catalog texts, families and table choice for questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.functions import fixed_values as fv
from khata.functions.text import contains_any, file_stem, month_index_in
from khata.operators.lookups import containing
from khata.session import written


# --- columns and their kinds ---------------------------------------------------------

def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def column_info(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables: name, type, place, nullable, kind."""
    rows = [(t, f.name, i, f.dataType.simpleString().upper(), f.nullable, kind_of(f.dataType))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, pos int, type string, nullable boolean, kind string")


def date_column(df: DataFrame) -> str | None:
    """A column of a date type first, else one whose name speaks of a date or period."""
    typed = columns_of_kind(df, "date")
    named = [c for c in df.columns if any(w in c.lower() for w in ("date", "period"))]
    return next(iter(typed + named), None)


# --- profiles ------------------------------------------------------------------------

def null_totals(df: DataFrame, columns: list[str], table: str = "source_table") -> DataFrame:
    """Missing cells of ``columns`` per table, in one pass."""
    total = reduce(Column.__add__, [F.count_if(F.col(c).isNull()) for c in columns])
    return df.groupBy(table).agg(total.alias("total_nulls"))


def null_counts(df: DataFrame, columns: list[str], table: str = "source_table") -> DataFrame:
    """Missing cells per table and column, only where there are any: one pass, then unpivoted."""
    wide = df.groupBy(table).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (wide.unpivot([table], columns, "column_name", "nulls").where(F.col("nulls") > 0))


def profile(df: DataFrame, table: str = "source_table", approximate: bool = False) -> DataFrame:
    """Rows, date range, distinct counts, sums and null shares per table of a family.

    Everything comes from one aggregation. Distinct counts cover the first two
    text columns, sums the first two numeric ones. ``approximate`` swaps exact
    distinct counts for sketches, which spares the extra shuffle of the exact ones.
    """
    data = [c for c in df.columns if c != table]
    body = df.select(*data)
    texts, numbers = columns_of_kind(body, "text")[:2], columns_of_kind(body, "number")[:2]
    day = date_column(body)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    rows = F.count(F.lit(1))
    aggs = [rows.alias("row_count")]
    if day:
        aggs += [F.min(day).cast("date").alias("min_date"), F.max(day).cast("date").alias("max_date")]
    aggs += [distinct(F.col(c)).alias(f"_u_{c}") for c in texts]
    aggs += [F.sum(c).cast("double").alias(f"_s_{c}") for c in numbers]
    aggs += [(F.count_if(F.col(c).isNull()) * F.lit(100.0) / rows).alias(f"_n_{c}") for c in data]
    out = df.groupBy(table).agg(*aggs)

    def as_map(prefix, names):
        pairs = [x for c in names for x in (F.lit(c), F.col(f"{prefix}{c}"))]
        return F.create_map(*pairs) if pairs else F.create_map()

    keep = [table, "row_count"] + (["min_date", "max_date"] if day else [])
    return out.select(*keep, F.lit(len(data)).cast("bigint").alias("column_count"), F.lit("unknown").alias("data_type"),
                      as_map("_u_", texts).alias("unique_counts"), as_map("_s_", numbers).alias("numeric_sums"),
                      as_map("_n_", data).alias("null_percentages"))


def sample_rows(df: DataFrame, order: list[str], table: str = "source_table", n: int = 3) -> DataFrame:
    """The first ``n`` rows of every table by ``order``, with their ``place``.

    Tables are first cut into parts by a hash of the order columns, so no table is sorted in one task.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    by = [F.col(c) for c in order]
    first = df.withColumn("_part", part).withColumn("_p", F.row_number().over(Window.partitionBy(table, "_part").orderBy(*by)))
    place = F.row_number().over(Window.partitionBy(table).orderBy(*by))
    few = first.where(F.col("_p") <= n).drop("_part", "_p").withColumn("place", place)
    return few.where(F.col("place") <= n)


def records(df: DataFrame, order: list[str], table: str = "source_table", catalog: DataFrame | None = None) -> DataFrame:
    """The catalog record of every table of a family: profile, period, description, keywords, sample rows, columns with
    sample values, example questions, and its relations: how many other tables share a telling column, and through which.

    ``catalog`` (table_name, column_name) lists the columns of all tables that may be related; by default, those of the family.
    The related tables themselves come from :func:`related_to`, for one table at a time: a list per record would be all pairs.
    """
    data = [c for c in df.columns if c != table]
    kinds = {c: k for k in ("number", "date", "text") for c in columns_of_kind(df.select(*data), k)}
    text = lambda c: F.col(c).cast("string")
    samples = sample_rows(df, order, table).groupBy(table).agg(
        F.array_sort(F.collect_list(F.struct("place", F.array(*[text(c) for c in data]).alias("values")))).alias("_s"))  # at most three
    rows = F.transform("_s", lambda x: F.map_from_arrays(F.array(*[F.lit(c) for c in data]), x["values"]))

    def values(i):
        return F.array_distinct(F.filter(F.transform("_s", lambda x: x["values"][i]), lambda v: v.isNotNull()))

    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString().upper()).alias("type"),
                                 values(i).alias("sample_values")) for i, c in enumerate(data)])
    profiled = profile(df, table)
    listed = profiled.select(F.col(table).alias("table_name"), F.explode(F.array(*[F.struct(
        F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.lit(kinds.get(c, "text")).alias("kind")) for i, c in enumerate(data)])).alias("c"))
    questions = example_questions(listed.select("table_name", "c.*")).withColumnRenamed("table_name", table)
    source = F.concat(F.col(table), F.lit(".csv"))
    relations = related_counts(listed.select("table_name", "c.column_name") if catalog is None else catalog)
    relations = relations.select(F.col("table_name").alias(table), F.struct("related", "via").alias("relations"))
    out = profiled.join(samples, table, "left").join(questions, table, "left").join(relations, table, "left")
    dated = "min_date" in out.columns
    return out.select(
        *profiled.columns, *([period_label(F.col("min_date"), F.col("max_date")).alias("period")] if dated else []),
        description(source).alias("description"), keywords(source, F.col(table), F.array(*[F.lit(c) for c in data])).alias("keywords"),
        rows.alias("sample_rows"), columns.alias("columns"), "example_questions", F.col("relations.related").alias("related"),
        F.col("relations.via").alias("related_via"))


def overview(df: DataFrame, table: str = "source_table", first_columns: int = 5) -> DataFrame:
    """Rows, columns, date range and null counts of the first columns per table."""
    data = [c for c in df.columns if c != table]
    dated = dated_column(data)
    aggs = [F.count(F.lit(1)).alias("row_count")]
    if dated:
        aggs += [F.min(dated).cast("string").alias("min_date"), F.max(dated).cast("string").alias("max_date")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in data[:first_columns]]
    return overview_rows(df.groupBy(table).agg(*aggs), table, data, dated is not None, first_columns)


def dated_column(data: list[str]) -> str | None:
    """The first column that a date range is taken from."""
    return next((c for c in data if any(w in c.lower() for w in ("date", "time", "created", "invoice"))), None)


def overview_rows(out: DataFrame, table: str, data: list[str], dated: bool, first_columns: int) -> DataFrame:
    """The overview from counts per table."""
    nulls = F.array_compact(F.array(*[
        F.when(F.col(f"_n_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_n_{c}"))) for c in data[:first_columns]]))
    return out.select(table, "row_count", F.lit(len(data)).cast("bigint").alias("column_count"),
                      *(["min_date", "max_date"] if dated else []), nulls.alias("null_columns"))


def period_label(first: Column, last: Column) -> Column:
    """One month, a span inside a year, or the fiscal years touched (from April)."""
    same_year = F.year(first) == F.year(last)
    fy_start = F.year(first) - F.when(F.month(first) >= 4, 0).otherwise(1)
    fy_end = F.year(last) + F.when(F.month(last) >= 4, 1).otherwise(0)
    return (F.when(first.isNull() | last.isNull(), F.lit(""))
             .when(same_year & (F.month(first) == F.month(last)), F.date_format(first, "MMMM yyyy"))
             .when(same_year, F.concat(F.date_format(first, "MMM"), F.lit(" - "), F.date_format(last, "MMM yyyy")))
             .otherwise(F.concat(F.lit("FY "), fy_start, F.lit("-"), F.substring(fy_end.cast("string"), -2, 2))))


# --- texts ---------------------------------------------------------------------------

def keywords(source_file: Column, table_name: Column, columns: Column, cap: int = 15) -> Column:
    """Sorted words of more than two letters from file, table and column names, plus named months."""
    def words(text, marks):
        return F.split(F.translate(F.lower(text), marks, " " * len(marks)), r"\s+")

    both = F.lower(F.concat(table_name, F.lit(" "), source_file))
    months = F.array_compact(F.array(*[F.when(both.contains(m[:3]), F.lit(m)) for m in fv.MONTHS]))
    parts = F.concat(words(file_stem(source_file), "_-"), words(table_name, "_"),
                     F.flatten(F.transform(columns, lambda c: words(c, "_"))))
    long_ones = F.filter(parts, lambda w: F.length(w) > 2)
    return F.slice(F.array_sort(F.array_distinct(F.concat(long_ones, months))), 1, cap)


def description(source_file: Column) -> Column:
    year = F.regexp_extract(source_file, r"20\d{2}", 0)
    month = month_index_in(F.lower(source_file), fv.MONTHS, short=False)
    named = F.element_at(F.array(*[F.lit(m.capitalize()) for m in fv.MONTHS]), month)
    return (F.when((year != "") & month.isNotNull(), F.concat(F.lit("Data for "), named, F.lit(" "), year))
             .when(year != "", F.concat(F.lit("Data from "), year))
             .otherwise(F.concat(F.lit("Data from "), F.translate(file_stem(source_file), "_-", "  "))))


def example_questions(columns: DataFrame) -> DataFrame:
    """Up to five example questions per table from its column kinds."""
    def first(kind):
        return F.min_by(F.when(F.col("kind") == kind, F.lower("column_name")),
                        F.when(F.col("kind") == kind, F.col("pos")))

    by = columns.groupBy("table_name").agg(first("number").alias("n"), first("text").alias("t"), first("date").alias("d"))
    made = F.array_compact(F.array(
        F.when(F.col("n").isNotNull(), F.concat(F.lit("Total of "), F.col("n"))),
        F.when(F.col("n").isNotNull() & F.col("t").isNotNull(),
               F.concat(F.lit("Sum of "), F.col("n"), F.lit(" by "), F.col("t"))),
        F.when(F.col("t").isNotNull(), F.concat(F.lit("Count by "), F.col("t"))),
        F.when(F.col("d").isNotNull() & F.col("n").isNotNull(),
               F.concat(F.lit("Trend of "), F.col("n"), F.lit(" over time"))),
        F.concat(F.lit("Show all data from "), F.col("table_name"))))
    return by.select("table_name", F.slice(made, 1, 5).alias("example_questions"))


def brief_line(description: Column, columns: Column, rows: Column) -> Column:
    return F.concat(description, F.lit(" ("), columns.cast("string"), F.lit(" columns, "), rows.cast("string"), F.lit(" rows)"))


def schema_text(catalog: DataFrame, columns: DataFrame) -> DataFrame:
    """Full schema text per table: source, description, range, columns, row count."""
    lines = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "column_name", "type"))),
        lambda c: F.concat(F.lit('    "'), c["column_name"], F.lit('" ('), c["type"], F.lit(")"))), "\n")
    body = columns.groupBy("table_name").agg(lines.alias("column_lines"))
    return catalog.join(body, "table_name").select("table_name", F.concat_ws(
        "\n", F.concat(F.lit("TABLE: "), "table_name"), F.concat(F.lit("  Source: "), "source_file"),
        F.concat(F.lit("  Description: "), "description"),
        F.concat(F.lit("  Date range: "), "min_date", F.lit(" to "), "max_date", F.lit(" ("), "period", F.lit(")")),
        F.lit("  Columns:"), F.col("column_lines"),
        F.concat(F.lit("  Total rows: "), F.col("row_count").cast("string"))).alias("schema_text"))


# --- families and relations ----------------------------------------------------------

def family_of(table_name: Column) -> Column:
    """Name without its date or number suffix, or the name itself."""
    dated = F.regexp_extract(table_name, fv.FAMILY_SUFFIX, 1)
    numbered = F.regexp_extract(table_name, fv.FAMILY_NUMBER, 1)
    return (F.when(dated != "", F.concat(dated, F.lit("_")))
             .when(numbered != "", F.concat(numbered, F.lit("_"))).otherwise(table_name))


def families(tables: DataFrame) -> DataFrame:
    """Tables of families with more than one member, with the family size."""
    named = tables.select("table_name", family_of(F.col("table_name")).alias("family"))
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    return named.join(sizes, "family")


def family_for_questions(questions: DataFrame, question: str, key: str, tables: DataFrame) -> DataFrame:
    """For questions that want everything: the first family whose base word they mention, or the only family."""
    sizes = (tables.groupBy(family_of(F.col("table_name")).alias("family"))
             .agg(F.min("table_name").alias("first"), F.count(F.lit(1)).alias("members")).where(F.col("members") > 1))
    sizes = written(sizes.select("family", "first"), "families")
    # trailing underscores go first, then trailing digits
    base = F.regexp_replace(F.regexp_replace("family", "_+$", ""), "[0-9]+$", "")
    bases = sizes.groupBy(base.alias("base")).agg(F.min_by("family", "first").alias("family"), F.min("first").alias("first"))
    wants = (questions.withColumn("_q", F.lower(question))
             .where(contains_any(F.col("_q"), fv.WANT_ALL_WORDS)).select(key, "_q"))
    hits = containing(wants, "_q", bases, "base").groupBy(key).agg(F.min_by("family", "first").alias("family"))
    only = sizes.agg(F.when(F.count(F.lit(1)) == 1, F.max("family"))).scalar()
    return (wants.select(key).join(hits, key, "left").withColumn("family", F.coalesce("family", only))
            .where(F.col("family").isNotNull()))


def schema_classes(columns: DataFrame) -> DataFrame:
    """(table_name, class, names): the telling column names that a table shares with others; tables of one set are a class.

    Generic names such as ``id`` or ``date`` do not count, nor do names that no other table has.
    """
    name = F.lower("column_name")
    told = columns.select("table_name", F.when(~name.isin(*fv.GENERIC_COLUMNS), name).alias("name")).distinct()
    shared = told.groupBy("name").agg(F.count("*").alias("_n")).where("name is not null and _n > 1").select("name", F.lit(True).alias("_s"))
    names = F.array_sort(F.collect_set(F.when(F.col("_s"), F.col("name"))))
    return (told.join(shared, "name", "left").groupBy("table_name").agg(names.alias("names"))
            .select("table_name", F.md5(F.array_join("names", "\x01")).alias("class"), "names"))


def related_counts(columns: DataFrame) -> DataFrame:
    """Per table: how many other tables share a telling column, and through which names.

    Tables are numbered; every name has a bitmap of the tables with it, in buckets of 32,768 tables, and a schema class counts
    the bits of its names' bitmaps together. No pair of tables or classes is made, however many share a name.
    """
    members = written(schema_classes(columns).withColumn("number", F.monotonically_increasing_id()), "schema-classes")
    bits = members.select("number", F.explode("names").alias("name")).groupBy("name", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    classes = members.groupBy("class").agg(F.first("names").alias("names")).select("class", F.explode("names").alias("name"))
    together = classes.join(bits, "name").groupBy("class", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("tables"))
    related = together.groupBy("class").agg((F.sum("tables") - 1).alias("related"))
    return members.join(related, "class", "left").select(
        "table_name", F.coalesce("related", F.lit(0)).cast("bigint").alias("related"), F.col("names").alias("via"))


def related_to(columns: DataFrame, table_name: str) -> DataFrame:
    """The tables related to one table, with the shared names: one pass over the columns of the catalog."""
    name = F.lower("column_name")
    own = columns.where((F.col("table_name") == table_name) & ~name.isin(*fv.GENERIC_COLUMNS)).select(name.alias("name")).distinct()
    others = columns.where(F.col("table_name") != table_name).select("table_name", name.alias("name"))
    return others.join(own, "name").groupBy("table_name").agg(F.array_sort(F.collect_set("name")).alias("via"))


def relation_lines(columns: DataFrame, table_name: str) -> DataFrame:
    """A line per table related to one table: ``a ↔ b (via x, y)``. All pairs of a catalog are never made."""
    return related_to(columns, table_name).select(F.concat(
        F.lit(f"  {table_name} ↔ "), "table_name", F.lit(" (via "), F.array_join("via", ", "), F.lit(")")).alias("line"))


# --- choosing tables for a question --------------------------------------------------

def choose_tables(questions: DataFrame, question: str, key: str, catalog: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best scoring tables per question, or the first table if none scores.

    Five points per keyword in the question, three per part of the table name,
    two for a consolidated table, four for a word of its period. ``catalog`` has
    pos, table_name, keywords and period. Words are postings of the tables that
    have them: questions meet the distinct words that they hold, and those the
    postings. Of tables that score without any word, the first ``n`` are enough.
    """
    def words(column, points, period):
        return catalog.select("pos", F.explode(column).alias("word")).select(
            "pos", "word", F.lit(points).alias("points"), F.lit(period).alias("period"))

    keywords = F.transform("keywords", F.lower)
    parts, period = F.split(F.lower("table_name"), "_"), F.split(F.lower("period"), " ")
    dated = F.when(F.array_join(period, "") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(period))
    postings = words(keywords, 5, 0).unionByName(words(parts, 3, 0)).unionByName(words(dated, 0, 4))
    postings = written(postings.groupBy("word", "pos").agg(F.sum("points").alias("points"), F.max("period").alias("period")), "postings")
    # an empty word is in every question
    empty = postings.where("word = ''").select("pos", (F.col("points") + F.col("period")).alias("empty"))
    bonus = F.when(F.lower("table_name").rlike("consolidated|all"), 2).otherwise(0)
    base = catalog.select("pos", "table_name", bonus.alias("bonus")).join(empty, "pos", "left").select(
        "pos", "table_name", (F.col("bonus") + F.coalesce("empty", F.lit(0))).alias("base"))

    texts = questions.select(key, F.lower(question).alias("_q"))
    hits = containing(texts, "_q", postings.where("word <> ''").select("word").distinct(), "word")
    scored = (hits.select(key, "word").join(postings, "word").groupBy(key, "pos").agg(
        F.sum("points").alias("points"), F.max("period").alias("period")).join(base, "pos").select(
            key, "pos", "table_name", (F.col("points") + F.col("period") + F.col("base")).alias("score")))
    # tables that score by themselves, and the first one for questions that nothing scores for: n + 1 rows
    ready = base.where("base > 0").orderBy(F.desc("base"), "pos").limit(n).unionByName(base.orderBy("pos").limit(1)).distinct()
    listed = ready.agg(F.collect_list(F.struct("pos", "table_name", F.col("base").alias("score")))).scalar()
    always = texts.select(key, F.explode(listed).alias("_t")).select(key, "_t.*")
    both = scored.unionByName(always).groupBy(key, "pos", "table_name").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    best = both.withColumn("_place", place).where(F.col("_place") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_place", "table_name", F.col("score").cast("bigint").alias("score"))))
    chosen = F.filter("_rows", lambda t: (t["score"] > 0) | (t["_place"] == 1))
    return best.groupBy(key).agg(rows.alias("_rows")).select(key, F.transform(
        chosen, lambda t: F.struct(t["table_name"].alias("table_name"), t["score"].alias("score"))).alias("tables"))
