"""Operators on the small fixtures that fix their semantics."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import addresses, identifiers, numbers, text
from ledgerloom.functions.money import close
from ledgerloom.operators import evaluation, hypotheses, scoring, spatial, support, validation
from ledgerloom.sources import readers


def test_close_tolerances(spark):
    rows = spark.createDataFrame([(10.0, 10.03), (10.0, 10.06), (1000.0, 1004.9), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(close(F.col("a"), F.col("b"))).collect()] == [True, False, True, None]


def test_signatures(spark):
    rows = spark.createDataFrame([("8750772763T03",), (" T00432214A ",), ("8716 860 570",)], "r string").select(text.signature(text.reference_key(F.col("r"))))
    assert [r[0] for r in rows.collect()] == ["D10-A1-D2", "A1-D8-A1", "D10"]


def test_line_check_needs_all_three(spark):
    rows = spark.createDataFrame([(1, 2.0, 10.0, 20.0), (1, 2.0, 10.0, 21.0), (1, None, 1.0, 1.0)], "doc_id long, quantity double, unit_price double, line_total double")
    assert [r["status"] for r in validation.check_lines(rows).collect()] == ["VALID", "INVALID", None]


def test_price_for_a_hundred_is_no_error(spark):
    rows = spark.createDataFrame([(1, 0, 200.0, 5.0, None, 100.0, 10.0), (1, 1, None, 5.0, None, None, 5.0)], "doc_id long, ix int, quantity double, unit_price double, net_unit_price double, price_unit double, line_total double")
    assert [(r["code"], r["path"]) for r in validation.audit_lines(rows).collect()] == [("QUANTITY_MISSING", "lines[1]")]


READING = "doc_id string, hyp string, material string, description string, quantity double, unit_price double, net_unit_price double, line_total double, raw_text string, reference_status string, reference_score double"


def test_complete_reading_beats_fragment(spark):
    line = lambda hyp, i: ("d", hyp, f"AB{i}", "pump", 1.0, 10.0, None, 10.0, "", "SUPPORTED", 0.9)
    lines = spark.createDataFrame([line("current", i) for i in range(11)] + [line("native_table", i) for i in range(2)], READING)
    none = spark.createDataFrame([], "doc_id string, hyp string, amount double")
    scores = hypotheses.score(lines, none, spark.createDataFrame([("d", 110.0)], "doc_id string, target double"))
    best = hypotheses.winner(scores).first()
    assert best["hyp"] == "current" and best["total_fit"] == 0.42 and best["reconciled"]
    assert [r["hyp"] for r in hypotheses.partial_rejections(scores).collect()] == ["native_table"]


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def test_greedy_matches_by_hand(spark):
    rng = random.Random(5)
    box = lambda: (x := rng.randint(0, 30), y := rng.randint(0, 30), x + rng.randint(5, 30), y + rng.randint(5, 30))
    predicted, truth = ([(g, i, *map(float, box())) for g in range(8) for i in range(rng.randint(0, 7))] for _ in range(2))
    columns = lambda p: f"g int, {p}ix int, " + ", ".join(f"{p}{i} double" for i in range(4))
    got = scoring.greedy_matches(spark.createDataFrame(predicted, columns("p")), spark.createDataFrame(truth, columns("t")), ["g"]).collect()
    want = set()
    for g in range(8):
        free = {t[1]: t[2:] for t in truth if t[0] == g}
        for p in (p for p in predicted if p[0] == g):
            best = max(((overlap(p[2:], t), -i) for i, t in free.items()), default=(0, 0))
            if best[0] > 0:
                want.add((g, p[1], -best[1], round(best[0], 9)))
                del free[-best[1]]
    assert {(r["g"], r["pix"], r["tix"], round(r["iou"], 9)) for r in got} == want


def test_a_drop_cap_bridges_no_rows(spark):
    words = [("d", 1, 0, "B", 0.0, 0.0, 20.0, 40.0), ("d", 1, 1, "on", 25.0, 2.0, 40.0, 12.0), ("d", 1, 2, "de", 25.0, 28.0, 40.0, 38.0), ("d", 1, 3, ".", 60.0, 10.0, 62.0, 12.0)]
    rows = spatial.rows_of_words(spark.createDataFrame(words, "doc_id string, page int, ix int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    row = {r["ix"]: r["row"] for r in rows}
    assert row[1] != row[2] and row[3] == row[1]


def test_boxes_of_regions(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import boxes

    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(
        boxes.overlaps(lit(0, 0, 2, 2), lit(2, 0, 4, 2)).alias("touch"), boxes.overlaps(lit(0, 0, 2, 2), lit(1, 1, 4, 2)).alias("over"), F.array(*boxes.shifted(lit(10, 990, 20, 999), F.lit(-15.0), F.lit(5.0))).alias("moved"),
        F.array(*boxes.from_thousand(lit(100, 200, 300, 400), F.lit(500.0), F.lit(1000.0))).alias("own"), boxes.valid_region(lit(0, 0, 0, 1)).alias("flat"), F.array(*boxes.union(lit(0, 5, 1, 6), lit(2, 1, 3, 2))).alias("both"), F.array(*boxes.to_thousand(lit(1, 2, 700, 900), 500, 800)).alias("thousand"),
    ).first()
    assert tuple(row) == (False, True, [0.0, 995.0, 5.0, 1000.0], [50.0, 200.0, 150.0, 400.0], False, [0.0, 1.0, 3.0, 6.0], [2, 2, 1000, 1000])


def test_split_is_stable(spark):
    a = evaluation.hash_split(spark.range(500).withColumnRenamed("id", "doc_id"))
    b = evaluation.hash_split(spark.range(300).withColumnRenamed("id", "doc_id"))
    assert set(b.collect()) <= set(a.collect())


def test_html_tables(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2 <b>x</b></td></tr></table><script>var t='<p>no</p>'</script><p>yes</p>"
    page = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r)[1:] for r in readers.html_tables(page).collect()] == [(0, 0, 0, "A"), (0, 0, 1, "B"), (0, 1, 0, "1"), (0, 1, 1, "2 x")]
    assert [r["text"] for r in readers.html_blocks(page).collect()] == ["yes"]


def test_passages_inside_words_and_short_ones(spark):
    texts = ["one two three four five six seven", "xone two three\nfour five sixy", "one two", None, "", "two  three four five six one two three four five six", "ne two three four five si"]
    passages = ["one two three four five six", "two", "ne two three four five si", None, "six seven eight nine ten eleven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    want = {(i, k) for i, t in enumerate(texts) for k, p in enumerate(passages) if t is not None and p is not None and p in t}
    got = [tuple(r) for r in support.holds(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_scalar_forms(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(numbers.money(F.lit(t))) for t in ("1 234,50 €", "1.234,50", "1,234.50", "12", "", "n/a", "1-2")] == [1234.5, 1234.5, 1234.5, 12.0, None, None, None]
    assert [value(numbers.accounting(F.lit(t))) for t in ("(1 234,50)", "-3", "1'000.5")] == [-1234.5, -3.0, 1000.5]
    assert value(numbers.native_decimal(F.lit("244,49000"))) == 244.49
    assert [tuple(value(numbers.split_sizes(F.lit(n).cast("long")))) for n in (0, 1, 2, 3, 10, 100)] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1), (6, 2, 2), (70, 15, 15)]
    assert [value(identifiers.reference(F.lit(t))) for t in ("8-703-406-153-0", "7733701936/LM", " 8716 860 570", "12-34", None)] == ["87034061530", "7733701936", "8716860570", "12-34", ""]
    assert value(identifiers.party_code(F.lit("cliO12S"))) == "CLIO125" and value(identifiers.party_code(F.lit("a b"))) == "a b"
    assert value(identifiers.without_repeats(F.lit("ACME Acme ACME - - Paris ,"))) == "ACME ACME - Paris"
    assert [value(identifiers.kept_phone(F.lit(t))) for t in ("01 02 03 04 05", "+49 30 1234567", "1111111111", "123456789", None)] == ["01 02 03 04 05", "+49 30 1234567", None, None, None]
    assert value(addresses.part(F.lit("av. Général Pruneau"))) == "AVENUE GENERAL PRUNEAU" and value(addresses.number(F.lit("002"))) == "2"
    assert [value(addresses.departments(F.lit(p))) for p in ("06003", "20100", "97400", None)] == [["06"], ["2A", "2B"], ["974"], []]
    assert tuple(value(addresses.town(F.lit("PARIS CEDEX 08")))) == ("PARIS", True, "08")
    assert value(addresses.key(F.lit("2"), F.lit(""), F.lit(""), F.lit("83000"), F.lit("Toulon"))) is None
    assert [value(identifiers.bad_order_number(F.lit(t))) for t in ("PO-123", "a@b12", "Total 12", "01 02 03 04 05", "A", None)] == [False, True, True, True, True, True]


def test_many_short_passages(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the pump 12 runs"), (2, "a"), (3, None), (4, "pump")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "pump"), (2, "p"), (3, ""), (4, "12 r"), (5, "zz"), (6, None), (7, "pump 12 runs on and")], "item_id long, passage string")
    few = sorted(map(tuple, support.holds(texts, passages).collect()))
    monkeypatch.setattr(support, "SHORT", 0)
    assert sorted(map(tuple, support.holds(texts, passages).collect())) == few == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (4, 1), (4, 2), (4, 3)]


def test_grams_prepare_a_text_once(spark):
    from ledgerloom.operators import learned

    df = spark.createDataFrame([("Le 12/05/2024 prix 3,50 n 123456789",), (None,), ("a",)], "text string").select(learned.grams(F.col("text")).alias("g"))
    assert df._jdf.queryExecution().analyzed().toString().count("<amount>") == 1
    rows = [r["g"] for r in df.collect()]
    head = " le  <date>  prix  <amount>  n  <longnum>  "
    assert rows[0] == [head[i : i + n] for n in (2, 3, 4) for i in range(len(head) - n + 1)]
    assert rows[1] == ["  "] and rows[2] == [" a", "a ", " a "]


def test_readings_of_few_charges_are_judged_by_word(spark):
    from ledgerloom.functions import judgements as J

    texts = ["Pompe 12", "FRAIS de port", "Fraïs de gestion", "ｆｒａｉｓ", "éco-participation", "Total HT", "pompe sport", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(J.may_hold(F.col("t"), J.FEE_WORDS).alias("may"), J.fee_kind(F.col("t")).alias("fee")).collect()
    assert [r["may"] for r in got] == [False, True, True, True, True, False, True, False, None]
    assert [r["fee"] for r in got] == [None, "shipping", "surcharge", "surcharge", "environmental_fee", None, None, None, None]


def test_readings_are_scored_in_one_exchange_of_lines(spark):
    line = lambda doc, hyp, text, price: (doc, hyp, "AB 1", text, 2.0, price, None, 2.0 * price, "", "SUPPORTED", 0.9)
    lines = spark.createDataFrame([line("d", "current", "pump", 10.0), line("d", "current", "frais de port", 5.0), line("d", "native_table", "12/05/2024", 10.0), line(None, "current", "pump", 1.0)], READING)
    charges = spark.createDataFrame([("d", "current", 3.0), ("d", "current", None), ("d", "geometry", 9.0), (None, "current", 7.0)], "doc_id string, hyp string, amount double")
    scores = hypotheses.score(lines, charges, spark.createDataFrame([("d", 33.0)], "doc_id string, target double"))
    assert {(r["doc_id"], r["hyp"]): (r["n"], r["noise"], r["reconciled"]) for r in scores.collect()} == {("d", "current"): (2, 1.0, True), ("d", "native_table"): (1, 0.0, False), (None, "current"): (1, 0.0, False)}
    # the lines with their charges, and the targets; before, readings went twice and charges once
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") == 1


def test_words_that_lie_by_document_are_sent_nowhere(spark):
    from ledgerloom.plans import tabled

    plan = tabled.table_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lines_of_pages(spark):
    from ledgerloom.operators import tables

    head = [("Ref", 20), ("Designation", 150), ("Qty", 330), ("Prix", 420)]
    pages = {
        ("d", 1): [(5, [("X-1111", 20), ("9", 330)]), (7, head), (9, [("AB-1234", 22), ("Pompe", 140), ("2", 331), ("3,50", 421)]), (10, [("avec", 140), ("joint", 160)]), (11, [("Total", 420), ("7,00", 500)]), (12, [("CD-1234", 20), ("no", 140), ("1", 330)])],
        ("d", 2): [(1, head), (2, [("AB-9999", 22), ("Vanne", 150), ("1", 331)]), (3, head[:2])],
        ("e", 1): [(1, head[:3]), (2, [("AB-1234", 22), ("Pompe", 140), ("2", 331)])],
    }
    words = [(d, p, r, r * 1000 + x, t, float(x), 0.0, float(x) + 10, 5.0) for (d, p), rows in pages.items() for r, ws in rows for t, x in ws]
    frame = spark.createDataFrame(words, "doc_id string, page int, row int, ix int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["doc_id"], r["ix"]): (r["page"], r["material"], r["description"], r["quantity"], r["unit_price"]) for r in tables.extract_lines(frame).collect()}
    assert got == {("d", 1): (1, "AB-1234", "Pompe avec joint", 2.0, 3.5), ("d", 2): (2, "AB-9999", "Vanne Ref Designation", 1.0, None)}
