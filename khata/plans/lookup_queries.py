"""Lookups of rates, bands, states and blocked items; running balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators import lookups, windows
from khata.plans import standins as st
from khata.plans.duck import any_contains, lit, values
from khata.plans.registry import query
from khata.session import shared_dir
from khata.sources import dimensions as dim

GOODS = values(fv.GOODS_CARD, "g", "pos, hsn_code, item_name, category, gst_rate, cess_rate")
SERVICES = values(fv.SERVICES_CARD, "s", "pos, sac_code, service_name, category, gst_rate, condition")

HSN_SQL = """
SELECT CASE p_type WHEN 'ECONOMY' THEN '0401' WHEN 'PROMO' THEN '3401' WHEN 'LARGE' THEN '8471'
            WHEN 'MEDIUM' THEN '7214' WHEN 'SMALL' THEN '847' ELSE '84AB' END"""

PART_TEXT_SQL = """
SELECT p_partkey, concat(p_name, ' ', p_type,
         CASE WHEN p_partkey % 9 = 0 THEN ' for motor repair'
              WHEN p_partkey % 9 = 4 THEN ' with outdoor catering' ELSE '' END) AS description
FROM {part}
"""

SEARCH_SQL = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN p_name
                                     WHEN 2 THEN 'Repair' ELSE substr(split_part(p_name, ' ', 2), 1, 3) END AS item
FROM {part}
"""

SAC_SQL = """
SELECT CASE event_type WHEN 'click' THEN '9992' WHEN 'view' THEN '9983' WHEN 'error' THEN '0000'
                       WHEN 'signup' THEN '9987' ELSE '9963' END AS sac_code, CAST(value AS DECIMAL(14,2)) AS amount
FROM {events}
"""

GOODS_LIST = [(n, c, r, g, x) for _, c, n, g, r, x in fv.GOODS_CARD]
SERVICES_LIST = [(n, c, r, g, x) for _, c, n, g, r, x in fv.SERVICES_CARD]
ITEM_RATES = [(n, r) for _, _, n, _, r, _ in fv.GOODS_CARD]

_EXACT_LATERAL = f"""
lines AS (
  SELECT hsn_code, count(*) AS lines, CAST(sum(taxable_value) AS DOUBLE) AS taxable FROM purchase_ledger GROUP BY hsn_code),
card AS (SELECT * FROM {GOODS}),
exact AS (SELECT l.hsn_code, c.pos, c.gst_rate, c.hsn_code AS rate_code FROM lines l JOIN card c ON c.hsn_code = l.hsn_code
          QUALIFY row_number() OVER (PARTITION BY l.hsn_code ORDER BY c.pos) = 1),
ranged AS (SELECT l.hsn_code, c.pos, c.gst_rate, c.hsn_code AS rate_code FROM lines l
           JOIN card c ON contains(c.hsn_code, '-') AND starts_with(l.hsn_code, substr(c.hsn_code, 1, 2))
           QUALIFY row_number() OVER (PARTITION BY l.hsn_code ORDER BY c.pos) = 1)
"""


def _lines_by_code(spark, d):
    lines = st.purchase_ledger(spark, d, "hsn_code", "taxable_value")
    return lines.groupBy("hsn_code").agg(F.count(F.lit(1)).alias("lines"),
                                         F.sum("taxable_value").cast("double").alias("taxable"))


def _rated(spark, d, mode):
    out = lookups.rate_by_code(_lines_by_code(spark, d), "hsn_code", dim.goods_card(spark), mode=mode)
    return out.select("hsn_code", "lines", "taxable", F.col("rate").cast("double").alias("rate"), "rate_code")


@query("j1_goods_rate", st.WITH_LEDGER + "," + _EXACT_LATERAL + """
SELECT l.hsn_code, l.lines, l.taxable,
       CAST(coalesce(e.gst_rate, r.gst_rate) AS DOUBLE) AS rate, coalesce(e.rate_code, r.rate_code) AS rate_code
FROM lines l LEFT JOIN exact e USING (hsn_code) LEFT JOIN ranged r USING (hsn_code)
""")
def j1_goods_rate(spark, d):
    return _rated(spark, d, "exact_then_range")


@query("j2_goods_rate_first_match", st.WITH_LEDGER + "," + _EXACT_LATERAL + """
SELECT l.hsn_code, l.lines, l.taxable, CAST(m.gst_rate AS DOUBLE) AS rate, m.rate_code
FROM lines l LEFT JOIN (
  SELECT * FROM (SELECT * FROM exact UNION ALL SELECT * FROM ranged)
  QUALIFY row_number() OVER (PARTITION BY hsn_code ORDER BY pos) = 1) m USING (hsn_code)
""")
def j2_goods_rate_first_match(spark, d):
    return _rated(spark, d, "first_match")


@query("j3_service_rate", f"""
WITH used AS ({st.duck(SAC_SQL)}),
card AS (SELECT * FROM {SERVICES} QUALIFY row_number() OVER (PARTITION BY sac_code ORDER BY pos) = 1),
sums AS (SELECT sac_code, count(*) AS uses, CAST(sum(amount) AS DOUBLE) AS amount FROM used GROUP BY sac_code)
SELECT u.sac_code, u.uses, u.amount, CAST(c.gst_rate AS DOUBLE) AS rate, c.service_name,
       c.category AS rate_category, c.condition
FROM sums u LEFT JOIN card c ON c.sac_code = u.sac_code
""")
def j3_service_rate(spark, d):
    used = st.from_sql(spark, d, SAC_SQL).groupBy("sac_code").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("amount").cast("double").alias("amount"))
    out = lookups.service_rate(used, "sac_code", dim.services_card(spark))
    return out.withColumn("rate", F.col("rate").cast("double"))


_SEARCH_MATCH = f"""
WITH q AS ({st.duck(SEARCH_SQL)}),
card AS (SELECT 1 AS grp, pos, 'goods' AS kind, hsn_code AS code, item_name AS name, gst_rate, category, cess_rate AS note FROM {GOODS}
         UNION ALL SELECT 2, pos, 'services', sac_code, service_name, gst_rate, category, condition FROM {SERVICES}),
hit AS (SELECT q.item, c.* FROM (SELECT DISTINCT item FROM q) q JOIN card c ON contains(lower(c.name), lower(q.item))
        QUALIFY row_number() OVER (PARTITION BY q.item ORDER BY grp, pos) = 1)
"""


@query("j4_rate_by_name", _SEARCH_MATCH + """
SELECT q.p_partkey, q.item, h.kind, h.code, h.name, CAST(h.gst_rate AS DOUBLE) AS rate, h.category
FROM q LEFT JOIN hit h USING (item)
""")
def j4_rate_by_name(spark, d):
    out = lookups.rate_by_name(st.from_sql(spark, d, SEARCH_SQL), "item", GOODS_LIST, SERVICES_LIST)
    return out.withColumn("rate", F.col("rate").cast("double")).drop("note")


_RATE_TEXT = ("CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS INT) AS VARCHAR) "
              "ELSE CAST(CAST({r} AS DOUBLE) AS VARCHAR) END")
_R = _RATE_TEXT.format(r="CAST(h.gst_rate AS DECIMAL(6,2))")
_HALF = "CAST(CAST(CAST(h.gst_rate AS DECIMAL(6,2)) * 0.5 AS DOUBLE) AS VARCHAR)"


@query("c14_rate_answer", _SEARCH_MATCH + f"""
SELECT q.p_partkey, CASE
  WHEN h.kind IS NULL THEN concat('Could not find GST rate for ''', q.item, ''' in our database. Please check the HSN/SAC code.')
  WHEN h.kind = 'goods' THEN concat('**GST Rate for ', h.name, '**', chr(10), chr(10), '- **HSN Code:** ', h.code, chr(10),
       '- **GST Rate:** ', {_R}, '%', chr(10), '- **Cess:** ', h.note, '%', chr(10), '- **Category:** ', h.category, chr(10), chr(10),
       'For intra-state supply: CGST = ', {_HALF}, '% + SGST = ', {_HALF}, '%', chr(10),
       'For inter-state supply: IGST = ', {_R}, '%')
  ELSE concat('**GST Rate for ', h.name, '**', chr(10), chr(10), '- **SAC Code:** ', h.code, chr(10),
       '- **GST Rate:** ', {_R}, '%', chr(10), '- **Category:** ', h.category,
       CASE WHEN h.note <> '' THEN concat(chr(10), '- **Condition:** ', h.note) ELSE '' END) END AS answer
FROM q LEFT JOIN hit h USING (item)
""")
def c14_rate_answer(spark, d):
    out = lookups.rate_by_name(st.from_sql(spark, d, SEARCH_SQL), "item", GOODS_LIST, SERVICES_LIST)
    return lookups.rate_answer(out, "item").select("p_partkey", "answer")


_FIRST_ITEM = f"""
WITH t AS ({st.duck(PART_TEXT_SQL)}), card AS (SELECT * FROM {GOODS}),
hit AS (SELECT u.description, c.gst_rate, c.item_name, c.pos FROM (SELECT DISTINCT description FROM t) u
        JOIN card c ON contains(lower(u.description), lower(c.item_name))
        QUALIFY row_number() OVER (PARTITION BY u.description ORDER BY c.pos) = 1)
"""


@query("j5_item_rate", _FIRST_ITEM + """
SELECT t.p_partkey, t.description, CAST(h.gst_rate AS DOUBLE) AS correct_rate FROM t LEFT JOIN hit h USING (description)
""")
def j5_item_rate(spark, d):
    out = lookups.rate_in_description(st.from_sql(spark, d, PART_TEXT_SQL), "description", ITEM_RATES)
    return out.withColumn("correct_rate", F.col("correct_rate").cast("double"))


@query("w1_first_match", _FIRST_ITEM + """
SELECT lower(description) AS description, item_name, CAST(pos AS BIGINT) AS pos FROM hit
""")
def w1_first_match(spark, d):
    texts = (st.from_sql(spark, d, PART_TEXT_SQL).select(F.lower("description").alias("description")).distinct())
    card = dim.goods_card(spark).select("pos", "item_name", F.lower("item_name").alias("needle"))
    hits = lookups.anchored_join(texts, "description", card, "needle")
    return hits.groupBy("description").agg(F.min_by("item_name", "pos").alias("item_name"),
                                           F.min("pos").cast("bigint").alias("pos"))


@query("j6_blocked_item", f"""
SELECT p_partkey, {any_contains("lower(description)", [i.lower() for i in fv.BLOCKED_ITEMS])} AS blocked
FROM ({st.duck(PART_TEXT_SQL)})
""")
def j6_blocked_item(spark, d):
    return st.from_sql(spark, d, PART_TEXT_SQL).select(
        "p_partkey", lookups.is_blocked_item(F.col("description")).alias("blocked"))


@query("j7_blocked_keyword", f"""
SELECT p_partkey, CAST(CASE {" ".join(
    f"WHEN {any_contains('lower(description)', list(g))} THEN {i}" for i, g in enumerate(fv.BLOCKED_KEYWORD_GROUPS, 1))}
  END AS BIGINT) AS keyword_group
FROM ({st.duck(PART_TEXT_SQL)})
WHERE {any_contains("lower(description)", [w for g in fv.BLOCKED_KEYWORD_GROUPS for w in g])}
""")
def j7_blocked_keyword(spark, d):
    texts = st.from_sql(spark, d, PART_TEXT_SQL).where(lookups.has_blocked_keyword(F.col("description")))
    return texts.select("p_partkey", lookups.blocked_keyword_group(F.col("description")).cast("bigint").alias("keyword_group"))


@query("j8_vendor_state", f"""
WITH v AS ({st.duck(st.VENDOR_SQL)})
SELECT v.vendor_id, substr(v.gstin, 1, 2) AS state_code, d.state_name, d.region, d.code IS NOT NULL AS state_valid
FROM v LEFT JOIN {values(fv.STATES, "d", "code, state_name, state_type, region")} ON d.code = substr(v.gstin, 1, 2)
""")
def j8_vendor_state(spark, d):
    vendors = st.from_sql(spark, d, st.VENDOR_SQL).select("vendor_id", F.substring("gstin", 1, 2).alias("state_code"))
    return lookups.state_of(vendors, "state_code", dim.states(spark))


@query("j9_msme_band", f"""
SELECT CASE WHEN turnover <= 50000000 THEN 'micro' WHEN turnover <= 500000000 THEN 'small'
            WHEN turnover <= 2500000000 THEN 'medium' ELSE 'large' END AS band, count(*) AS vendors
FROM ({st.duck(st.VENDOR_SQL)}) GROUP BY 1
""")
def j9_msme_band(spark, d):
    vendors = st.from_sql(spark, d, st.VENDOR_SQL)
    return vendors.groupBy(lookups.msme_band(F.col("turnover")).alias("band")).agg(F.count(F.lit(1)).alias("vendors"))


@query("j10_slab_rate", f"""
SELECT CAST(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT) AS BIGINT) AS charged_rate,
       CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT) IN ({", ".join(map(str, fv.SLAB_RATES))}) AS is_slab, count(*) AS lines
FROM lineitem GROUP BY 1, 2
""")
def j10_slab_rate(spark, d):
    rates = st.purchase_ledger(spark, d, "charged_rate").groupBy(F.col("charged_rate").cast("bigint").alias("charged_rate"))
    return rates.agg(F.count(F.lit(1)).alias("lines")).withColumn("is_slab", lookups.is_slab_rate(F.col("charged_rate")))


@query("s23_slab_dimension", f"""
SELECT s.slab_name, s.examples, count(*) AS lines
FROM (SELECT CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT) AS rate FROM lineitem) l
LEFT JOIN {values(fv.SLABS, "s", "slab_name, rate, examples")} ON s.rate = l.rate
GROUP BY s.slab_name, s.examples
""")
def s23_slab_dimension(spark, d):
    rates = (st.purchase_ledger(spark, d, "charged_rate").groupBy(F.col("charged_rate").alias("rate"))
             .agg(F.count(F.lit(1)).alias("n")))
    out = rates.join(F.broadcast(dim.slabs(spark)), "rate", "left")
    return out.groupBy("slab_name", "examples").agg(F.sum("n").alias("lines"))


@query("s28_rule_constants", f"""
WITH l AS (SELECT o_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT {lit(fv.COMPLIANCE_RULES["payment_rule"])} AS rule, CAST(45 AS BIGINT) AS days_limit, count(*) AS lines,
       count(*) FILTER (WHERE days > 45) AS beyond
FROM l
""")
def s28_rule_constants(spark, d):
    rules = dim.compliance_rules(spark)
    limit = rules.select(F.col("days_limit").cast("bigint")).scalar()
    lines = st.table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(
        st.table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    out = lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(days > limit).alias("beyond"))
    return out.select(rules.select("payment_rule").scalar().alias("rule"), limit.alias("days_limit"), "lines", "beyond")


@query("v13_tax_split", st.WITH_LEDGER + """
SELECT CAST(charged_rate AS BIGINT) AS charged_rate, intra,
       CAST(CASE WHEN intra THEN charged_rate * 0.5 ELSE 0 END AS DOUBLE) AS cgst_rate,
       CAST(CASE WHEN intra THEN charged_rate * 0.5 ELSE 0 END AS DOUBLE) AS sgst_rate,
       CAST(CASE WHEN intra THEN 0 ELSE charged_rate END AS DOUBLE) AS igst_rate, lines
FROM (SELECT charged_rate, vendor_state = customer_state AS intra, count(*) AS lines
      FROM (SELECT CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT) AS charged_rate, s_nationkey AS vendor_state, c_nationkey AS customer_state
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN supplier ON l_suppkey = s_suppkey)
      GROUP BY 1, 2)
""")
def v13_tax_split(spark, d):
    rates = (st.purchase_ledger(spark, d, "charged_rate", "intra").groupBy("charged_rate", "intra")
             .agg(F.count(F.lit(1)).alias("lines")))
    split = lookups.tax_split(F.col("charged_rate"), F.col("intra"))
    return rates.select(F.col("charged_rate").cast("bigint").alias("charged_rate"), "intra", "lines",
                        *[split[c].cast("double").alias(c) for c in ("cgst_rate", "sgst_rate", "igst_rate")])


@query("w6_running_balance", f"""
SELECT event_id, CAST(credit AS DOUBLE) AS credit, CAST(debit AS DOUBLE) AS debit,
       CAST(sum(credit - debit) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
FROM ({st.duck(st.BANK_SQL)})
""")
def w6_running_balance(spark, d):
    bank = st.from_sql(spark, d, st.BANK_SQL).withColumn("change", F.col("credit") - F.col("debit"))
    out = windows.running_total(bank, "change", "ts", ["event_id"], "balance")
    return out.select("event_id", *[F.col(c).cast("double").alias(c) for c in ("credit", "debit", "balance")])


#: A card of every part: some thousand rows at the larger scales, a few hundred at the smallest.
_PART_CARD = "SELECT p_partkey AS pos, 'goods' AS kind, p_name AS name, concat('C', p_partkey) AS code, p_size % 28 AS rate FROM part"


@query("j4_rate_by_name_large_card", f"""
WITH card AS ({_PART_CARD}), q AS (SELECT p_partkey, substr(p_name, 3, 5) AS item FROM part),
hit AS (SELECT item, min(pos) AS pos FROM (SELECT DISTINCT item FROM q) q JOIN card ON contains(lower(name), lower(item)) GROUP BY item)
SELECT q.p_partkey, q.item, c.code, CAST(c.rate AS DOUBLE) AS rate FROM q LEFT JOIN hit USING (item) LEFT JOIN card c USING (pos)
""")
def j4_rate_by_name_large_card(spark, d):
    part = st.table(spark, d, "part")
    card = part.select(F.col("p_partkey").alias("pos"), F.lit("goods").alias("kind"), F.col("p_name").alias("name"),
                       F.format_string("C%d", F.col("p_partkey")).alias("code"), (F.col("p_size") % 28).alias("rate"),
                       F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("note"))
    out = lookups.rate_by_name_in(part.select("p_partkey", F.substring("p_name", 3, 5).alias("item")), "item", card)
    return out.select("p_partkey", "item", "code", F.col("rate").cast("double").alias("rate"))


@query("j5_item_rate_large_card", f"""
WITH card AS ({_PART_CARD}), t AS (SELECT p_partkey, concat('box of ', upper(p_name), ' x') AS description FROM part),
hit AS (SELECT description, min(pos) AS pos FROM (SELECT DISTINCT description FROM t) t JOIN card ON contains(lower(description), lower(name)) GROUP BY 1)
SELECT t.p_partkey, CAST(c.rate AS DOUBLE) AS correct_rate FROM t LEFT JOIN hit USING (description) LEFT JOIN card c USING (pos)
""")
def j5_item_rate_large_card(spark, d):
    part = st.table(spark, d, "part")
    card = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("item_name"), (F.col("p_size") % 28).alias("gst_rate"))
    texts = part.select("p_partkey", F.concat(F.lit("box of "), F.upper("p_name"), F.lit(" x")).alias("description"))
    out = lookups.rate_in_description(texts, "description", card)
    return out.select("p_partkey", F.col("correct_rate").cast("double").alias("correct_rate"))


@query("s23_card_csv", """
SELECT row_number() OVER (ORDER BY p_partkey) AS pos, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS hsn_code, p_name AS item_name,
       CAST(p_size AS VARCHAR) AS gst_rate FROM part
""")
def s23_card_csv(spark, d):
    path = shared_dir(spark, "card")
    (st.table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("hsn_code"), F.col("p_name").alias("item_name"),
                                       F.col("p_size").alias("gst_rate"))
     .repartitionByRange(3, "hsn_code").sortWithinPartitions("hsn_code").write.option("header", True).csv(path))
    return dim.read_dimension(spark, path, ["hsn_code", "item_name", "gst_rate"], "hsn_code")
