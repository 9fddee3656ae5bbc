"""Lookups, running totals, ranks and spellings against brute force."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from khata.functions import fixed_values as fv
from khata.operators import lookups, metrics, names, windows
from khata.sources import dimensions as dim


def rates(spark, codes, mode):
    df = spark.createDataFrame([(c,) for c in codes], "hsn_code string")
    out = lookups.rate_by_code(df, "hsn_code", dim.goods_card(spark), mode=mode)
    return {r.hsn_code: r.rate for r in out.collect()}


def test_code_rates_d3_d4(spark):
    codes = ["0401", "9999999", "8471", "7102", "8433"]
    exact = rates(spark, codes, "exact_then_range")
    assert exact == {"0401": 0, "9999999": None, "8471": 18, "7102": Decimal("0.25"), "8433": 5}
    assert rates(spark, codes, "first_match")["8471"] == 5


def test_service_rates(spark):
    df = spark.createDataFrame([("9992",), ("0000",)], "sac string")
    got = {r.sac: r.rate for r in lookups.service_rate(df, "sac", dim.services_card(spark)).collect()}
    assert got == {"9992": 0, "0000": None}


def test_first_row_of_a_repeated_code_counts(spark):
    card = dim.goods_card(spark, [(1, "2106", "First", "a", "5", "0"), (2, "2106", "Second", "a", "18", "0")])
    df = spark.createDataFrame([("2106",)], "hsn_code string")
    assert lookups.rate_by_code(df, "hsn_code", card).first().rate == 5


@pytest.mark.parametrize("turnover,band", [(10**7, "micro"), (5 * 10**7, "micro"), (10**8, "small"), (10**9, "medium"), (5 * 10**9, "large")])
def test_bands(spark, turnover, band):
    df = spark.createDataFrame([(turnover,)], "t bigint")
    assert df.select(lookups.msme_band(F.col("t"))).first()[0] == band


def test_bands_join_agrees(spark):
    df = spark.range(0, 4_000_000_000, 50_000_000).withColumnRenamed("id", "t")
    bands = dim.msme_bands(spark)
    joined = df.join(F.broadcast(bands), (F.col("t") > F.col("over")) & ((F.col("t") <= F.col("upto")) | F.col("upto").isNull()))
    assert joined.where(F.col("band") != lookups.msme_band(F.col("t"))).count() == 0
    assert joined.count() == df.count()


def test_states(spark):
    df = spark.createDataFrame([("27",), ("29",), ("25",), ("88",)], "code string")
    got = {r.code: (r.state_name, r.state_valid) for r in lookups.state_of(df.withColumn("c", F.col("code")), "c", dim.states(spark)).collect()}
    assert got["27"] == ("Maharashtra", True) and got["29"] == ("Karnataka", True)
    assert got["25"] == (None, False) and got["88"] == (None, False)  # D18


def test_slab_rates(spark):
    df = spark.createDataFrame([(r,) for r in (0, 5, 12, 18, 28, 15, 100)], "r int")
    assert [r.r for r in df.where(lookups.is_slab_rate(F.col("r"))).collect()] == [0, 5, 12, 18, 28]


def test_item_rate_by_expression_and_by_join_agree(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["oil", "boiler", "soap", "bar", "ring", "gear", "string", "car", "carbon", "a"]
    texts = [(" ".join(rnd.choice(words) for _ in range(4)),) for _ in range(200)]
    card_rows = [(i, w.title(), str(i)) for i, w in enumerate(["oil", "ring", "bar soap", "carbon", "gear a", "zz"], 1)]
    card = dim.inline(spark, card_rows, ["pos", "item_name", "gst_rate"])
    df = spark.createDataFrame(texts, "description string")
    small = {(r.description, r.correct_rate) for r in lookups.rate_in_description(df, "description", card).collect()}
    monkeypatch.setattr(lookups, "CARD_BOUND", 2)
    large = {(r.description, r.correct_rate) for r in lookups.rate_in_description(df, "description", card).collect()}
    want = {(t, next((Decimal(r) for _, n, r in card_rows if n.lower() in t), None)) for (t,) in texts}
    assert small == large == want


def test_every_reference_dimension_has_rows(spark, tmp_path):
    assert dim.states(spark).count() == 38
    assert dim.blocked_items(spark).count() == 15
    assert dim.slabs(spark).where("slab_name = 'luxury'").first().rate == 28
    assert dim.compliance_rules(spark).first().days_limit == fv.PAYMENT_LIMIT_DAYS
    (tmp_path / "card.csv").write_text("hsn_code,item_name,gst_rate\n0401,Milk,0\n0402,\"Curd, Lassi\",5\n")
    card = dim.read_dimension(spark, str(tmp_path / "card.csv"), ["hsn_code", "item_name", "gst_rate"])
    assert [(r.hsn_code, r.item_name, r.pos) for r in card.orderBy("pos").collect()] == [("0401", "Milk", 1), ("0402", "Curd, Lassi", 2)]


def test_running_total_matches_a_plain_loop(spark):
    rnd = random.Random(1)
    data = sorted((rnd.choice("ab"), rnd.randrange(10**6), i, Decimal(rnd.randrange(-500, 500))) for i in range(3000))
    df = spark.createDataFrame(data, "k string, s bigint, i int, v decimal(10,2)").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.total for r in windows.running_total(df, "v", "ts", ["i"], "total", keys=["k"]).collect()}
    acc, want = {"a": 0, "b": 0}, {}
    for k, _, i, v in data:
        acc[k] += v
        want[i] = acc[k]
    assert got == want


def test_value_at_rank_matches_sorting(spark):
    rnd = random.Random(2)
    data = [(k, float(rnd.choice([rnd.randrange(3), rnd.random() * 5000, -1.5]))) for k in "abc" for _ in range(rnd.randrange(1, 900))]
    df = spark.createDataFrame(data, "op string, v double")
    got = {r.op: r.v for r in metrics.value_at_rank(df, ["op"], "v", F.floor(F.col("n") * F.lit(0.95)) + 1).collect()}
    for k in "abc":
        vals = sorted(v for o, v in data if o == k)
        assert got[k] == vals[int(len(vals) * 0.95)]


@pytest.mark.parametrize("edits", [1, 2])
def test_likely_spelling_matches_brute_force(spark, edits):
    rnd = random.Random(4)
    base = ["ENTERPRISES", "ENTERPRICES", "TRADERS", "TRADER", "STORE", "STORES", "AB", "BA", "A", ""]
    texts = [rnd.choice(base) for _ in range(300)] + ["TRADERZ", "XTRADERS", "ENTERRISES", "TARDERS", "STROE", "ETERPRISESS", "ÉNTERPRICE", "B"]
    texts += ["".join(rnd.choice("AB") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "n string")
    got = {(r.name, r.likely) for r in names.likely_spelling(rows, "n", edits).collect()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    uses = {t: texts.count(t) for t in set(texts)}
    want = set()
    for a in uses:
        near = [(uses[b], b) for b in uses if a != b and edit(a, b) <= edits and (uses[b], b) > (uses[a], a)]
        if near:
            want.add((a, max(near)[1]))
    assert got == want


def test_patterns_of_names_are_moved_once(spark, capsys):
    rows = spark.createDataFrame([("Suplier#1",), ("Supplier#1",), ("Supplier#1",), ("Supplier#23",), ("a\x01b\x02",), ("a\x01b",), ("",)], "n string")
    found = names.likely_spelling(rows, "n", 2)
    assert {(r.name, r.likely) for r in found.collect()} == {("Suplier#1", "Supplier#1"), ("Supplier#23", "Supplier#1"), ("a\x01b", "a\x01b\x02")}
    found.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("hashpartitioning(key") <= 1


def test_hubs_of_names_are_never_broadcast(spark):
    """However small the names are on disk: an explode makes many times as much of them."""
    rows = spark.createDataFrame([("Suplier#1",), ("Supplier#1",), ("Supplier#1",)], "n string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = names.likely_spelling(rows, "n", 2)
        assert [(r.name, r.likely) for r in found.collect()] == [("Suplier#1", "Supplier#1")]
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_answer_for_every_card_size(spark):
    """Empty, null and upper-case names, in a card of a few rows and in one of many."""
    few = [(1, "", 28), (2, None, 18), (3, "LAPTOP", 12), (4, "Laptop bag", 5)]
    many = few + [(5 + i, f"other thing {i}", 1) for i in range(400)]
    texts = spark.createDataFrame([(1, "big laptop bag"), (2, "pen"), (3, None), (4, "")], "k int, description string")
    got = []
    for rows in (few, many):
        card = spark.createDataFrame(rows, "pos int, item_name string, gst_rate int")
        out = lookups.rate_in_description(texts, "description", card)
        got.append({r.k: r.correct_rate and int(r.correct_rate) for r in out.collect()})
    assert got[0] == got[1] == {1: 12, 2: None, 3: None, 4: None}
    full = [(p, "goods", n, str(p), r, None, None) for p, n, r in many]
    card = spark.createDataFrame(full, "pos int, kind string, name string, code string, rate int, category string, note string")
    queries = spark.createDataFrame([(1, "TOP"), (2, "nothing"), (3, None), (4, "")], "k int, q string")
    assert {r.k: r.code for r in lookups.rate_by_name_in(queries, "q", card).collect()} == {1: "3", 2: None, 3: None, 4: "1"}


def test_anchored_search_matches_plain_search(spark, monkeypatch):
    """Needles of one letter up to whole texts, over windows that cut needles apart."""
    monkeypatch.setattr(lookups, "WINDOW", 50)
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 90))) for _ in range(400)]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(40)] + [words[0], "", "😀ab", None]
    words += ["😀a", "nowhere", "", None]
    found = lookups.anchored_join(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t",
                                  spark.createDataFrame(list(enumerate(words)), "n int, w string").where("w <> ''"), "w")
    assert found.columns == ["k", "t", "n", "w"]
    want = {(k, n) for k, t in enumerate(texts) for n, w in enumerate(words) if t and w and w in t}
    got = [(r.k, r.n) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_many_needles_in_long_texts(spark):
    """10,000 needles of 40 lengths over texts of 1 MB."""
    rnd = random.Random(9)
    needles = ["".join(rnd.choice("abcdefghij") for _ in range(3 + i % 40)) for i in range(10_000)]
    texts = [" ".join(rnd.choice(needles) if rnd.random() < 0.002 else "filler text" for _ in range(88_000)) for _ in range(2)]
    found = lookups.anchored_join(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t",
                                  spark.createDataFrame([(n,) for n in set(needles)], "w string"), "w")
    got = {(r.k, r.w) for r in found.select("k", "w").collect()}
    assert got == {(k, n) for k, t in enumerate(texts) for n in set(needles) if n in t}
