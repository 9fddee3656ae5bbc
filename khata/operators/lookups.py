"""Rate, band and state lookups as joins or as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.functions.text import contains_any
from khata.session import rows_if_small

# Cards up to this many rows are compiled into the row expression; larger ones are joined.
CARD_BOUND = 256


def first_per_key(card: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row per ``key``: the one that comes first. ``min_by`` pre-aggregates, a window would not."""
    rest = [c for c in card.columns if c != key]
    first = F.min_by(F.struct(*rest), F.col(pos))
    return card.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")


def rate_by_code(df: DataFrame, code: str, card: DataFrame, card_code: str = "hsn_code",
                 mode: str = "exact_then_range") -> DataFrame:
    """Add the card row of a code as ``rate_*`` columns; codes without one keep nulls.

    A card code such as ``8432-8436`` stands for every code with its first two
    digits. ``exact_then_range`` prefers an exact row; ``first_match`` takes
    whichever row comes first in the card.
    """
    picked = ["pos", "gst_rate", "category", card_code]
    exact = first_per_key(card.select(*picked), card_code)
    exact = exact.select(F.col(card_code).alias("_code"), F.struct("pos", "gst_rate", "category", F.col(card_code).alias("code")).alias("_exact"))
    ranged = card.select(*picked).where(F.col(card_code).contains("-"))
    ranged = first_per_key(ranged.withColumn("_prefix", F.substring(card_code, 1, 2)), "_prefix")
    ranged = ranged.select("_prefix", F.struct("pos", "gst_rate", "category", F.col(card_code).alias("code")).alias("_ranged"))

    out = (df.join(exact, F.col(code) == F.col("_code"), "left")
             .join(ranged, F.substring(code, 1, 2) == F.col("_prefix"), "left"))
    if mode == "first_match":
        hit = F.when(F.col("_exact.pos") <= F.col("_ranged.pos"), F.col("_exact")).otherwise(
            F.coalesce("_ranged", "_exact"))
    elif mode == "exact_then_range":
        hit = F.coalesce("_exact", "_ranged")
    else:
        raise ValueError(f"unknown mode {mode}")
    return (out.withColumn("_hit", hit)
               .withColumn("rate", F.col("_hit.gst_rate"))
               .withColumn("rate_code", F.col("_hit.code"))
               .withColumn("rate_category", F.col("_hit.category"))
               .drop("_code", "_exact", "_prefix", "_ranged", "_hit"))


def service_rate(df: DataFrame, code: str, card: DataFrame) -> DataFrame:
    """Exact service code lookup, first row per code."""
    first = first_per_key(card.select("sac_code", "pos", "service_name", "category", "gst_rate", "condition"), "sac_code")
    first = first.select(F.col("sac_code").alias("_sac"), F.col("gst_rate").alias("rate"), "service_name",
                         F.col("category").alias("rate_category"), "condition")
    return df.join(first, F.col(code) == F.col("_sac"), "left").drop("_sac")


def card_entries(card: DataFrame, name: str, *values: str) -> list[tuple] | None:
    """(name, values...) of a small card in card order, None when it is too large for that."""
    rows = rows_if_small(card.select("pos", name, *values), CARD_BOUND)
    if rows is None:
        return None
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["pos"])]


def first_entry(test, entries: list[tuple], value_index: int, as_type: str) -> Column:
    """Value of the first entry for which ``test(entry name)`` holds, as one CASE expression."""
    out = None
    for e in entries:
        value = F.lit(e[value_index]).cast(as_type)
        out = F.when(test(e[0]), value) if out is None else out.when(test(e[0]), value)
    return out if out is not None else F.lit(None).cast(as_type)


def rate_in_description(df: DataFrame, description: str, card: DataFrame | list[tuple],
                        name: str = "item_name", rate: str = "gst_rate") -> DataFrame:
    """Add ``correct_rate``: rate of the first card item whose name is inside the description.

    ``card`` is a list of (name, rate) or a frame with ``pos``. A small card
    becomes a CASE expression, so the rows never move. A larger one is joined
    on exact pieces of the distinct descriptions. Either way names are compared
    in the lower case of Spark, and null and empty names stand for nothing.
    """
    entries = card if isinstance(card, list) else card_entries(card, name, rate)
    if entries is not None:
        text = F.lower(F.col(description))
        return df.withColumn("correct_rate", first_entry(
            lambda n: text.contains(F.lower(F.lit(n))), [e for e in entries if e[0]], 1, "decimal(6,2)"))

    texts = df.select(F.lower(description).alias("_text")).distinct()
    hits = containing(texts, "_text", card.select("pos", F.lower(name).alias("_name"), rate), "_name")
    best = hits.groupBy("_text").agg(F.min_by(F.col(rate), F.col("pos")).cast("decimal(6,2)").alias("correct_rate"))
    return (df.withColumn("_key", F.lower(description))
              .join(best.withColumnRenamed("_text", "_key"), "_key", "left").drop("_key"))


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """All (text, needle) rows where the needle occurs in the text.

    A small set of needles is tested inside each text row. Otherwise texts and needles meet in the rarest letters that a
    needle has: only needles that may be in a text are ever tested, never all pairs.
    """
    needles = needles.where(F.length(needle) > 0)
    if rows_if_small(needles.select(needle), CARD_BOUND) is not None:
        listed = needles.agg(F.collect_list(F.struct(*needles.columns))).scalar()
        hits = F.filter("_needles", lambda n: F.col(text).contains(n[needle]))
        return (texts.withColumn("_needles", listed).withColumn("_hit", F.explode(hits))
                     .select(*texts.columns, "_hit.*"))
    return anchored_join(texts, text, needles, needle)


#: Letters of a gram, and letters of a text that are cut into grams at a time.
GRAM, WINDOW = 3, 4096


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` letters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"))


def anchored_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """All (text, needle) rows where the needle occurs in the text.

    Each needle stands under that of its grams which fewest needles have; needles shorter than a gram are grams themselves.
    Every distinct text is cut into its grams once, window by window; grams meet anchors on equality, and each text is then
    searched for the needles that it may hold.
    """
    size, digest = F.least(F.length(needle), F.lit(GRAM)), F.md5(text)
    own = needles.select(F.col(needle).alias("_anchored")).distinct()
    cut = own.select("_anchored", F.explode(F.array_distinct(F.when(F.length("_anchored") >= GRAM, _grams(F.col("_anchored"), GRAM)).otherwise(
        F.array("_anchored")))).alias("_gram"))
    common = cut.groupBy("_gram").agg(F.count("*").alias("_n"))
    anchors = cut.join(common, "_gram").groupBy("_anchored").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    sizes = [r[0] for r in needles.select(size.alias("s")).distinct().collect()]  # three at most
    window = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{WINDOW + GRAM - 1}}})).{{1,{WINDOW}}}"))
    windows = texts.select(text).distinct().select(digest.alias("_digest"), F.explode(window).alias("_window"))
    grams = windows.select("_digest", F.explode(F.array_distinct(F.concat(
        F.array().cast("array<string>"), *[_grams(F.col("_window"), s) for s in sizes]))).alias("_gram"))
    maybe = grams.join(anchors, "_gram").groupBy("_digest").agg(F.collect_set("_anchored").alias("_maybe"))
    hits = texts.withColumn("_digest", digest).join(maybe, "_digest").withColumn(
        "_anchored", F.explode(F.filter("_maybe", lambda n: F.col(text).contains(n))))
    return hits.join(needles, F.col("_anchored") == F.col(needle)).select(*texts.columns, *needles.columns)


def rate_by_name_in(df: DataFrame, query: str, card: DataFrame) -> DataFrame:
    """:func:`rate_by_name` for a card of any size: a frame of pos, kind, name, code, rate, category, note.

    Distinct query texts are looked for in the card's names; goods come first by their ``pos``. An empty text is in
    every name; a null one has no rate.
    """
    texts = df.select(F.lower(query).alias("_q")).distinct().where("_q is not null")
    names = card.where("name is not null").select("pos", F.lower("name").alias("_name"))
    hits = containing(names, "_name", texts, "_q").groupBy("_q").agg(F.min("pos").alias("_pos"))
    first = names.agg(F.min("pos").alias("_pos")).where("_pos is not null").select(F.lit("").alias("_q"), "_pos")
    found = hits.unionByName(first).join(card.withColumnRenamed("pos", "_pos"), "_pos").drop("_pos")
    return df.withColumn("_q", F.lower(query)).join(found, "_q", "left").drop("_q")


def rate_by_name(df: DataFrame, query: str, goods: list[tuple], services: list[tuple]) -> DataFrame:
    """First card row whose name holds the query text; goods come before services.

    ``goods`` and ``services`` are lists in card order of (name, code, rate, category,
    note); the note is the cess of goods and the condition of services. Adds ``kind``,
    ``code``, ``name``, ``rate``, ``category``, ``note``; nulls where nothing holds it.
    """
    text = F.lower(F.col(query))
    hit = None
    for kind, entries in (("goods", goods), ("services", services)):
        for name, code, rate, category, note in entries:
            row = F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(name).alias("name"),
                           F.lit(rate).cast("decimal(6,2)").alias("rate"), F.lit(category).alias("category"),
                           F.lit(note).alias("note"))
            test = F.lit(name.lower()).contains(text)
            hit = F.when(test, row) if hit is None else hit.when(test, row)
    return df.withColumn("_hit", hit).select("*", "_hit.*").drop("_hit")


def is_blocked_item(description: Column, items: list[str] = fv.BLOCKED_ITEMS) -> Column:
    """Strict form: a whole blocked item name is inside the description."""
    return contains_any(F.lower(description), [i.lower() for i in items])


def has_blocked_keyword(description: Column, groups: list[tuple] = fv.BLOCKED_KEYWORD_GROUPS) -> Column:
    """Default form: any word of any keyword group is inside the description."""
    return contains_any(F.lower(description), [w for g in groups for w in g])


def blocked_keyword_group(description: Column, groups: list[tuple] = fv.BLOCKED_KEYWORD_GROUPS) -> Column:
    """1-based number of the first group with a word inside the description."""
    text, out = F.lower(description), None
    for i, g in enumerate(groups, 1):
        hit = contains_any(text, list(g))
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def state_of(df: DataFrame, code: str, states: DataFrame) -> DataFrame:
    """Add ``state_name`` and ``state_valid`` for a two-digit code; the 38 states are broadcast."""
    dim = F.broadcast(states.select(F.col("code").alias("_code"), "state_name", "region"))
    return (df.join(dim, F.col(code) == F.col("_code"), "left")
              .withColumn("state_valid", F.col("_code").isNotNull()).drop("_code"))


def msme_band(turnover: Column) -> Column:
    out = None
    for band, limit, _ in fv.MSME_BANDS:
        hit = turnover <= F.lit(limit)
        out = F.when(hit, F.lit(band)) if out is None else out.when(hit, F.lit(band))
    return F.when(turnover.isNotNull(), out.otherwise("large"))


def is_slab_rate(rate: Column) -> Column:
    return rate.isin(*fv.SLAB_RATES)


def tax_split(rate: Column, same_state: Column) -> Column:
    """Rate halves inside a state, the whole rate across states."""
    half = (rate.cast("decimal(6,2)") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(8,3)")
    zero = F.lit(0).cast("decimal(8,3)")
    return F.struct(
        F.when(same_state, half).otherwise(zero).alias("cgst_rate"),
        F.when(same_state, half).otherwise(zero).alias("sgst_rate"),
        F.when(same_state, zero).otherwise(rate.cast("decimal(8,3)")).alias("igst_rate"))


def rate_text(rate: Column) -> Column:
    """A rate as text, whole numbers without decimals."""
    return F.when(rate == F.floor(rate), rate.cast("int").cast("string")).otherwise(rate.cast("double").cast("string"))


def rate_answer(df: DataFrame, item: str) -> DataFrame:
    """Answer text for the row found by :func:`rate_by_name`."""
    half = (F.col("rate") * F.lit("0.5").cast("decimal(2,1)")).cast("double").cast("string")
    text = F.when(
        F.col("kind").isNull(),
        F.concat(F.lit("Could not find GST rate for '"), F.col(item),
                 F.lit("' in our database. Please check the HSN/SAC code.")),
    ).when(
        F.col("kind") == "goods",
        F.concat(F.lit("**GST Rate for "), F.col("name"), F.lit("**\n\n- **HSN Code:** "), F.col("code"),
                 F.lit("\n- **GST Rate:** "), rate_text(F.col("rate")), F.lit("%\n- **Cess:** "), F.col("note"), F.lit("%\n- **Category:** "), F.col("category"),
                 F.lit("\n\nFor intra-state supply: CGST = "), half, F.lit("% + SGST = "), half,
                 F.lit("%\nFor inter-state supply: IGST = "), rate_text(F.col("rate")), F.lit("%")),
    ).otherwise(
        F.concat(F.lit("**GST Rate for "), F.col("name"), F.lit("**\n\n- **SAC Code:** "), F.col("code"),
                 F.lit("\n- **GST Rate:** "), rate_text(F.col("rate")), F.lit("%\n- **Category:** "), F.col("category"),
                 F.when(F.col("note") != "", F.concat(F.lit("\n- **Condition:** "), F.col("note"))).otherwise("")))
    return df.withColumn("answer", text)
