"""Audit, strategy, recommendations, catalog and retrieval on small inputs."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from khata.operators import audit, catalog, family, recommend, retrieval, strategy
from khata.plans.lookup_queries import ITEM_RATES
from khata.sources import dimensions as dim

TODAY = dt.date(2026, 1, 31)


def as_of():
    return F.lit(TODAY)


def ledger(spark, *data, schema):
    return spark.createDataFrame([tuple(Decimal(str(x)) if isinstance(x, float) else x for x in r) for r in data], schema)


def test_rate_check_uses_the_item_card_d1_d4(spark):
    df = ledger(spark, ("Bath Soap", 18.0, 1000.0), ("Rough Diamonds", 3.0, 1000.0), ("Pen", 18.0, 10.0), ("Soap", None, 10.0), ("Soap", 0.0, 10.0),
                schema="description string, gst_rate decimal(6,2), taxable_value decimal(14,2)")
    got = {r.description: r for r in audit.check_rates(df, ITEM_RATES, []).collect()}
    assert len(got) == 2
    soap = got["Item 'bath soap' charged at 18.0% but 2026 rate is 5%"]
    assert (soap.severity, soap.amount_impact) == ("warning", 130)
    assert "Item 'rough diamonds' charged at 3.0% but 2026 rate is 0.25%" in got


def test_half_rates_are_doubled_full_ones_are_not_d5(spark):
    half = ledger(spark, ("Soap", 9.0, 1000.0), schema="item string, cgst_rate decimal(6,2), taxable_amount decimal(14,2)")
    full = ledger(spark, ("Soap", 18.0, 1000.0), schema="item string, tax_rate decimal(6,2), base_amount decimal(14,2)")
    assert audit.check_rates(half, ITEM_RATES, []).first().amount_impact == 130
    assert audit.check_rates(full, ITEM_RATES, []).first().amount_impact == 130
    whole_tax = ledger(spark, ("motor car", 90.0), schema="item string, tax_amount decimal(14,2)")
    half_tax = ledger(spark, ("motor car", 90.0), schema="item string, cgst_amount decimal(14,2)")
    assert audit.check_blocked(whole_tax, []).first().amount_impact == 90
    assert audit.check_blocked(half_tax, []).first().amount_impact == 180


def test_blocked_keywords_and_strict_items_d2(spark):
    df = ledger(spark, ("club snacks", 1.0), ("Outdoor Catering service", 1.0), ("pencils", 1.0), schema="item string, cgst_amount decimal(14,2)")
    assert audit.check_blocked(df, []).count() == 2
    assert audit.check_blocked(df, [], strict=True).count() == 1


def test_ageing_covers_the_whole_table_d6_d7(spark):
    old, new = TODAY - dt.timedelta(days=46), TODAY - dt.timedelta(days=45)
    df = spark.createDataFrame([(old, "V", Decimal(5), TODAY)] * 300 + [(new, "V", Decimal(5), None), (None, "V", Decimal(5), None)],
                               "bill_date date, party_name string, bill_amount decimal(14,2), payment_date date")
    issues = audit.check_ageing(df, as_of(), [])
    assert issues.count() == 300
    assert issues.first().description == "Payment to 'V' overdue by 1 days (45-day limit)"


def test_audit_totals(spark):
    df = ledger(spark, ("Soap for motor", 18.0, 1000.0, 90.0, dt.date(2025, 1, 1), "V", 1180.0),
                schema="description string, gst_rate decimal(6,2), taxable_value decimal(14,2), cgst_amount decimal(14,2), "
                       "invoice_date date, vendor string, total_value decimal(14,2)")
    t = audit.audit_summary(audit.audit_totals(audit.audit(df, ITEM_RATES, as_of()))).first()
    assert (t.issues, t.critical, t.warning, t.info, t.total_savings, t.total_risk) == (3, 1, 2, 0, 130.0, 1180.0)
    assert "Amount at Risk: ₹1,180" in t.summary


def test_vendor_scores_find_supplier_name_d8_d9(spark):
    df = spark.createDataFrame([("t1", "A", 1.0)] * 2 + [("t2", "A", 1.0)] * 12 + [("t1", None, 1.0)], "source_table string, supplier_name string, total_amount double")
    got = {r.source_table: (r.score, r.risk_factors) for r in strategy.vendor_scores(df).collect()}
    assert got == {"t1": (60, ["Limited transaction history"]), "t2": (100, [])}
    assert strategy.vendor_scores(df, by_table=False).first().transactions == 14


def test_cash_flow_sums_over_tables_d10(spark):
    sales = spark.createDataFrame([("sales_1", 100.0)] * 30 + [("sales_2", 300.0)] * 30, "source_table string, total_value double")
    buys = spark.createDataFrame([("purchase_1", 50.0)] * 15, "source_table string, total_value double")
    got = strategy.cash_flow(sales, buys, as_of()).orderBy("month_no").collect()
    assert [r.period for r in got] == ["March 2026", "April 2026", "May 2026"]
    first = got[0]
    assert (first.inflows, first.outflows, first.tax) == (6000.0, 750.0, pytest.approx(5250 * 0.09))
    assert got[2].inflows == pytest.approx(6600) and [round(r.confidence, 2) for r in got] == [1, 0.85, 0.7]


def test_strategy_notes_none(spark):
    scores = spark.createDataFrame([(90, 5.0)], "score bigint, total_value double")
    flow = spark.createDataFrame([(1.0, 0.0)], "net double, tax double")
    assert [r.note for r in strategy.strategy_notes(scores, flow).collect()] == ["No immediate strategic concerns identified."]


def recs(spark, with_msme):
    gaps = spark.createDataFrame([("t1", 11), ("t2", 10)], "source_table string, total_nulls bigint")
    critical = spark.createDataFrame([(i, "section_43b_h", f"d{i}", Decimal(i)) for i in (1, 2, 3)],
                                     "place int, issue_type string, description string, amount_impact decimal(10,2)")
    flow = spark.createDataFrame([(i, f"M{i}", -10.0) for i in range(4)], "month_no bigint, period string, net double")
    scores = spark.createDataFrame([(55, 2e5), (55, 1.0)], "score bigint, total_value double")
    return recommend.recommendations(gaps, critical, flow, scores, with_msme_check=with_msme)


def test_recommendations(spark):
    all_of_them = recs(spark, False)
    assert sorted(r.rec_id for r in all_of_them.collect()) == [f"REC-{i:03d}" for i in range(1, 7)]
    kept = recommend.without_repeats(all_of_them)
    top = recommend.prioritized(kept).collect()
    assert [(r.rec_id, r.priority) for r in top] == [("REC-002", "critical"), ("REC-005", "high"), ("REC-006", "medium"), ("REC-001", "medium")]
    assert top[1].description == "Negative cash flow projected for M0, M1, M2. Total deficit: ₹40"
    text = recommend.summary(recommend.prioritized(kept)).first().summary
    assert text == ("1 CRITICAL item(s) require immediate attention. 1 HIGH priority item(s) should be addressed soon. "
                    "Top focus areas: compliance (1), cash_flow (1), vendor (1)")
    assert recommend.by_id(kept, "REC-001").count() == recommend.by_category(kept, "vendor").count() == 1


def test_msme_check_d19(spark):
    assert recs(spark, True).where("deadline = 'Before next filing'").first().title == "Verify MSME status of major vendors"


def test_reply_parsing(spark):
    reply = ("TITLE: One\nDESCRIPTION: first: of all\nPRIORITY: high\nCATEGORY: RISK\nACTIONS:\n- a\n\n- b\nend\n- c\n---\nTITLE: no description\n"
             "---\n title: Two\ndescription: x")
    got = recommend.parse_replies(spark.createDataFrame([(1, reply)], "k int, reply string"), "reply", ["k"]).orderBy("rec_id").collect()
    assert [(r.rec_id, r.title, r.description, r.priority, r.category, r.actions, r.impact) for r in got] == [
        ("REC-001", "One", "first: of all", "high", "risk", ["a", "b"], 75), ("REC-002", "Two", "x", "medium", "operational", [], 50)]


# --- catalog -------------------------------------------------------------------------

def test_profile_and_keywords_d13_d21(spark):
    df = spark.createDataFrame([("t", "a", 1, None), ("t", "b", 2, None)], "source_table string, name string, n int, due string")
    p = catalog.profile(df).first()
    assert (p.row_count, p.column_count, p.unique_counts, p.numeric_sums["n"]) == (2, 3, {"name": 2, "due": 0}, 3.0)
    assert p.null_percentages == {"name": 0.0, "n": 0.0, "due": 100.0}
    kw = spark.range(1).select(catalog.keywords(F.lit("Market-data.csv"), F.lit("market_data"), F.array(F.lit("Item_no")))).first()[0]
    assert kw == ["data", "item", "march", "market"]


@pytest.mark.parametrize("a,b,label", [("2021-07-01", "2021-07-31", "July 2021"), ("2021-07-01", "2021-12-31", "Jul - Dec 2021"),
                                       ("2021-07-01", "2022-01-31", "FY 2021-22"), ("2021-01-01", "2022-05-31", "FY 2020-23")])
def test_period(spark, a, b, label):
    df = spark.range(1).select(catalog.period_label(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert df.first()[0] == label


def test_families(spark):
    names = ["purchase_2021_07", "purchase_2021_08", "sales_1", "sales_22", "other", "bank_202107"]
    got = {(r.table_name, r.family) for r in catalog.families(spark.createDataFrame([(n,) for n in names], "table_name string")).collect()}
    assert got == {("purchase_2021_07", "purchase_"), ("purchase_2021_08", "purchase_"), ("sales_1", "sales_"), ("sales_22", "sales_")}


def test_relations_match_all_pairs(spark):
    tables = {"a": ["id", "Vendor", "x"], "b": ["vendor", "y"], "c": ["id", "date"], "d": ["vendor", "y"], "e": ["X"]}
    cols = spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "table_name string, column_name string")
    low = {t: {c.lower() for c in cs} - {"id", "date"} for t, cs in tables.items()}
    want = {t: sum(1 for o in low if o != t and low[o] & low[t]) for t in low}
    assert {r.table_name: r.related for r in catalog.related_counts(cols).collect()} == want
    assert {(r.table_name, tuple(r.via)) for r in catalog.related_to(cols, "a").collect()} == {
        ("b", ("vendor",)), ("d", ("vendor",)), ("e", ("x",))}


def test_relations_of_many_tables(spark):
    """A name that all of 100,000 distinct schemas have: counts come from bitmaps, no pair is made."""
    cols = spark.range(100_000).select(F.concat(F.lit("t"), "id").alias("table_name"), F.explode(F.array(
        F.lit("Vendor"), F.concat(F.lit("own"), "id"), F.concat(F.lit("part"), F.floor(F.col("id") / 50)), F.lit("id"))).alias("column_name"))
    got = catalog.related_counts(cols)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in got.groupBy("related", F.size("via")).count().collect()] == [(99_999, 2, 100_000)]
    few = cols.where(~F.col("column_name").isin("Vendor"))
    assert [tuple(r) for r in catalog.related_counts(few).groupBy("related").count().collect()] == [(49, 100_000)]


def test_table_choice_matches_plain_scores(spark):
    """A catalog of thousands of tables with words common to all, against scoring table by table."""
    listing = [(i, f"purchase_2021_{i:02d}", ["purchase", "2021", m], f"{m} 2021")
               for i, m in enumerate(["january", "february", "march", "april", "may"], 1)] + [(9, "all_sales", ["sales"], "")]
    listing += [(10 + i, f"ledger_{i}_purchase", ["ledger", "purchase", f"n{i}"], "") for i in range(3000)]
    cat = spark.createDataFrame(listing, "pos int, table_name string, keywords array<string>, period string")
    questions = {1: "purchases in March 2021", 2: "sales please", 3: "zzz", 4: "may", 5: "the n17 ledger", 6: ""}
    qs = spark.createDataFrame(list(questions.items()), "id int, q string")
    got = {r.id: [(t.table_name, t.score) for t in r.tables] for r in catalog.choose_tables(qs, "q", "id", cat).collect()}

    def plain(q):
        scored = []
        for pos, name, words, period in listing:
            score = 5 * sum(w in q for w in words) + 3 * sum(w in q for w in name.split("_")) + 2 * ("all" in name or "consolidated" in name)
            score += 4 * (period != "" and any(w in q for w in period.lower().split(" ")))
            scored.append((-score, pos, name))
        best = sorted(scored)[:3]
        return [(n, -s) for s, _, n in best if s < 0] or [(best[0][2], 0)]

    assert got == {k: plain(q.lower()) for k, q in questions.items()}
    # keywords purchase, 2021 and march; name parts purchase and 2021; a word of the period
    assert got[1][0] == ("purchase_2021_03", 3 * 5 + 2 * 3 + 4)
    assert got[3] == [("all_sales", 2)]


def test_family_union_and_partitioned_dataset(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0, "x")], "k int, v double, note string")
    both = family.union_family({"p_2021_01": a, "p_2021_02": b})
    assert sorted((r.k, r.source_table, r.note) for r in both.collect()) == [(1, "p_2021_01", None), (2, "p_2021_02", "x")]
    family.write_family(both, str(tmp_path / "fam"))
    plan = spark.read.parquet(str(tmp_path / "fam")).where("source_table = 'p_2021_02'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(source_table" in plan._jdf.queryExecution().toString()


# --- retrieval -----------------------------------------------------------------------

def test_chunks_always_advance_d11(spark):
    text = "Hi. " + "x" * 3000
    spans = list(retrieval.chunk_spans(text))
    assert spans[0] == (0, 4) and spans[1][0] == 4
    assert all(b > a for a, b in spans) and all(n[0] > p[0] for p, n in zip(spans, spans[1:]))
    assert spans[-1][1] >= len(text)


def test_chunks_cover_the_text_and_keep_words(spark):
    body = ". ".join(f"Sentence number {i} goes here" for i in range(400)) + "."
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id int, text string")
    got = retrieval.chunk_documents(df, "doc_id", "text").orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_index for r in got] == list(range(len(got)))
    assert all(len(r.chunk) <= 1000 and r.chunk in body for r in got)
    at = 0
    for r in got:
        start = body.index(r.chunk, max(0, at - 1000))
        assert start <= at
        at = start + len(r.chunk)
    assert at == len(body)


def test_memory_of_a_block_does_not_grow_with_it(monkeypatch):
    rnd, order, held = np.random.default_rng(5), np.lexsort, []
    have, want = (rnd.integers(-3, 4, size=(n, 8)).astype(float) for n in (3000, 300))  # whole numbers: no rounding
    have[100:] = have[0]  # ties
    ids = pa.chunked_array([pa.array(rnd.permutation(len(have)))])

    def lexsort(keys):
        held.append(len(keys[0]))
        return order(keys)

    monkeypatch.setattr(np, "lexsort", lexsort)
    monkeypatch.setattr(retrieval, "DISTANCES", 6000)
    row, col, d = retrieval._best(have, ids, want, 5)
    assert max(held) <= 6000 and (np.bincount(row) == 5).all()
    far, name = 1.0 - want @ have.T, ids.to_numpy()
    for q in range(300):
        best = np.argsort(far[q] * 10_000 + name)[:5]
        assert col[row == q].tolist() == best.tolist() and d[row == q].tolist() == far[q][best].tolist()


def test_queries_go_to_cells_in_small_batches(spark, monkeypatch):
    most, sent = 40, retrieval._sent
    monkeypatch.setattr(retrieval, "ASKED_AT_ONCE", most)
    vectors = np.random.default_rng(6).normal(size=(500, 6)).tolist()
    asked = pa.RecordBatch.from_pydict({"query_id": list(range(500)), "embedding": vectors})
    pivots = retrieval._unit(np.array(vectors[:32]))
    around = retrieval.Around(pivots, [(c, 20, 2.0) for c in range(32)], 5)
    assert sent(asked.slice(40, most), "embedding", around).num_rows == most * 32
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert retrieval.nearest(rows, rows.withColumnRenamed("vec_id", "query_id"), 2).where("place = 1 and query_id = vec_id").count() == 500



@pytest.mark.parametrize("pool_block,query_block,pivots,n", [(8192, 1024, 32, 4), (7, 5, 3, 4), (1, 1, 1, 2), (50, 3, 200, 500)])
def test_nearest_matches_brute_force(spark, monkeypatch, pool_block, query_block, pivots, n):
    """Clustered vectors, equal ones, zero ones on both sides, repeated ids, missing vectors, fewer chunks than wanted."""
    for name, value in (("POOL_BLOCK", pool_block), ("QUERY_BLOCK", query_block), ("PIVOTS", pivots)):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(7)
    centers = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vecs = [[x + r.gauss(0, 0.1) for x in r.choice(centers)] for _ in range(120)] + [[0.0] * 6] * 3 + [centers[0]] * 4
    rows = [(i, v) for i, v in enumerate(vecs)] + [(500, None)]
    asked = [(1000 + i, v) for i, v in enumerate(r.sample(vecs, 25) + [[0.0] * 6, centers[1]])] + [(2000, None)]
    schema = "vec_id long, embedding array<double>"
    got = {}
    for x in retrieval.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema.replace("vec_id", "query_id")), n).collect():
        got.setdefault(x.query_id, []).append((x.place, x.vec_id, x.distance))

    def cosine(a, b):
        la, lb = (math.sqrt(sum(x * x for x in v)) or 1.0 for v in (a, b))
        return 1.0 - sum(x * y for x, y in zip(a, b)) / (la * lb)

    assert set(got) == {q for q, v in asked if v}
    for q, v in asked:
        if v:
            want = sorted((round(cosine(v, w), 9), i) for i, w in rows if w)[:n]
            found = sorted((round(d, 9) + 0.0, i) for _, i, d in got[q])
            assert [d for d, _ in found] == pytest.approx([d for d, _ in want], abs=1e-8) and len({p for p, _, _ in got[q]}) == len(want)
            clear = want[-1][0] - 1e-7  # ids are as in brute force but for ties at the end
            assert {i for d, i in found if d < clear} == {i for d, i in want if d < clear}


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert retrieval.nearest(empty, some).count() == 0
    assert retrieval.nearest(some.withColumnRenamed("query_id", "vec_id"), empty.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_pages_and_context(spark):
    pages = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "")], "k int, p int, t string")
    assert retrieval.assemble_pages(pages, "k", "p", "t").first().full_text == "\n[Page 1]\na\n[Page 2]\nb"
    found = spark.createDataFrame([(1, 2, None, "s", "two"), (1, 1, "Act", None, "one")], "query_id int, place int, source string, section string, text string")
    assert retrieval.context_text(found).first().context == "[1] Act \none\n\n---\n\n[2] Unknown s\ntwo"


def test_card_is_read_once_per_code(spark):
    assert dim.goods_card(spark).groupBy("hsn_code").count().where("count > 1").count() == 0
