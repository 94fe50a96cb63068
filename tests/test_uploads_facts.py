import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ratelens.operators import facts
from ratelens.sources import uploads


def test_tables_are_mapped_by_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Банк;Ставка, %;Комментарий\nA;5,5;x\nB;;\n", encoding="utf-8")
    rows = uploads.read_delimited(spark, str(path), {"bank": ["банк"], "rate": ["ставка"], "title": ["название"]}).collect()
    assert [(r.bank, r.rate, r.title, r.terms) for r in rows] == [("A", "5,5", None, {"Комментарий": "x"}), ("B", None, None, {})]


def test_dumps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("URL: https://x/y\nH1: Title\n\n<TEXT>\nbody: 1\nmore\n")
    (tmp_path / "b.txt").write_text("URL: z\n")
    rows = sorted(uploads.read_dumps(spark, str(tmp_path)).collect(), key=lambda r: r.file)
    assert rows[0].header == {"URL": "https://x/y", "H1": "Title"} and rows[0].text == "body: 1\nmore"
    assert rows[1].text is None


def test_manifest(spark):
    stored = spark.createDataFrame([("s", "old", 1), ("s", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881", 2)], "source string, sha256 string, fetched_at int")
    manifest = spark.createDataFrame([("s", b"x", "text/html"), ("s", b"y", "text/html"), ("t", b"y", "image/png"), (None, b"y", "text/html"), ("u", b"", "text/html")], "source string, content binary, content_type string")
    got = [(r.status, r.reason) for r in uploads.import_manifest(manifest, stored, ["text/html"]).collect()]
    assert sorted(got, key=str) == sorted([("unchanged", None), ("imported", None), ("rejected", "content_type"), ("rejected", "no_source"), ("rejected", "empty")], key=str)


VALID = ["7707083893", "7736050003", "500100732259"]


def test_ids(spark):
    rows = spark.createDataFrame([("a.txt", "7707083893, 7707083894 500100732259 7707083893"), ("b.txt", None)], "f string, t string")
    assert {(r.file, r.id, r.valid, r.truncated) for r in uploads.ids_in_text(rows, "t", "f").collect()} == {("a.txt", "7707083893", True, False), ("a.txt", "7707083894", False, False), ("a.txt", "500100732259", True, False)}


def test_ids_are_limited_in_each_file(spark):
    rows = spark.createDataFrame([("a", " ".join(VALID)), ("b", f"{VALID[0]} 7707083894 {VALID[1]}")], "f string, t string")
    got = sorted((r.file, r.id, r.valid, r.truncated) for r in uploads.ids_in_text(rows, "t", "f", 2).collect())
    assert got == [("a", VALID[0], True, True), ("a", VALID[1], True, True), ("b", VALID[0], True, False), ("b", "7707083894", False, False), ("b", VALID[1], True, False)]


def test_links(spark):
    page = '<a href="/loans/a?utm_source=x">1</a><a href="https://www.bank.ru/deposits/b">2</a><a href="https://other.ru/loans/c">3</a><a href="/about">4</a>'
    pages = spark.createDataFrame([("https://bank.ru/x", page), ("https://bank.ru/y", page)], "u string, h string")
    got = {(r.link, r.category, r.page) for r in uploads.discovered_links(pages, "u", "h", ["bank.ru"], [("loan", "loan"), ("deposit", "deposit")]).collect()}
    assert got == {("https://bank.ru/loans/a", "loan", "https://bank.ru/x"), ("https://www.bank.ru/deposits/b", "deposit", "https://bank.ru/x")}


def test_site_tree(spark):
    nodes = spark.createDataFrame([(1, None, "personal", "Personal"), (2, 1, "loans", "Loans"), (3, 2, "cash", "Special offer"), (4, None, "business", "Business"), (5, 1, "old", "Old")], "id int, parent int, alias string, title string")
    got = {(r.path, r.is_promo) for r in uploads.site_catalogue(nodes, ["personal"], "/old$", "offer").collect()}
    assert got == {("/personal", False), ("/personal/loans", False), ("/personal/loans/cash", True)}


def test_site_tree_may_be_deep_and_have_cycles(spark):
    nodes = [(0, None, "personal", "P")] + [(i, i - 1, f"a{i}", "T") for i in range(1, 130)] + [(200, 201, "x", "X"), (201, 200, "y", "Y"), (202, 999, "z", "Z")]
    got = uploads.site_catalogue(spark.createDataFrame(nodes, "id int, parent int, alias string, title string"), ["personal"], "^$", "offer").collect()
    assert len(got) == 130 and max(r.path.count("/") for r in got) == 130


def test_repeated_fields_take_the_first_by_text(spark):
    day = datetime.date(2026, 1, 2)
    cards = spark.createDataFrame([(1, None, None, None, None, None, day)], "product int, min_days int, max_days int, terms array<int>, min_amount decimal(18,2), max_amount decimal(18,2), fetched_at date")
    details = spark.createDataFrame([], "product int, min_days int, max_days int, min_amount decimal(18,2), max_amount decimal(18,2), fetched_at date")
    extra = spark.createDataFrame([(1, "min_days", "91"), (1, "min_days", "30"), (1, None, "5"), (1, "max_days", None)], "product int, field string, value string")
    row = facts.assemble(cards, details, extra).first()
    assert (row.min_days, row.max_days) == (30, None)


def test_registry(spark):
    payload = '{"suggestions":[{"value":"A","data":{"inn":"1","name":{"short_with_opf":"LLC A"},"state":{"status":"ACTIVE"}}},{"value":"B","data":{"inn":"2","branch_type":"BRANCH"}}]}'
    rows = uploads.registry_cards(spark.createDataFrame([(payload,)], "p string"), "p").collect()
    assert [(r.inn, r.name_full, r.name_short, r.status) for r in rows] == [("1", "A", "LLC A", "ACTIVE")]


def test_layout_is_voted(spark):
    below = "Loan one\n10,5 %\nLoan two\n11 %\n"
    above = "12 %\nCard one\n13 %\nCard two"
    rows = spark.createDataFrame([(1, below), (2, above)], "id int, body string")
    got = sorted((r.id, r.title, r.rate) for r in uploads.rates_by_title(rows, "id", "body").collect())
    assert got == [(1, "Loan one", 10.5), (1, "Loan two", 11.0), (2, "Card one", 12.0), (2, "Card two", 13.0)]


def test_state(spark):
    page = '<script id="s" type="application/json">{&q;a&q;:1}</script>'
    assert spark.createDataFrame([(page,), ("none",)], "p string").select(uploads.ssr_state(F.col("p")).alias("s")).collect()[0].s == '{"a":1}'


def test_facts(spark):
    day = datetime.date
    cards = spark.createDataFrame([(1, 30, 400, [91, 183], Decimal(100), None, day(2026, 1, 2)), (2, 30, 400, [10], Decimal(100), None, day(2026, 1, 2)), (3, None, None, None, None, None, day(2026, 1, 2))], "product int, min_days int, max_days int, terms array<int>, min_amount decimal(18,2), max_amount decimal(18,2), fetched_at date")
    details = spark.createDataFrame([(1, 60, 365, Decimal(200), Decimal(900), day(2026, 1, 1)), (2, 60, 365, Decimal(100), None, day(2026, 1, 3))], "product int, min_days int, max_days int, min_amount decimal(18,2), max_amount decimal(18,2), fetched_at date")
    extra = spark.createDataFrame([(3, "min_days", "91"), (1, "max_amount", "5")], "product int, field string, value string")
    got = {r["product"]: r for r in facts.assemble(cards, details, extra).collect()}
    assert (got[1].min_days, got[1].terms, got[1].min_amount, got[1].max_amount) == (30, [91, 183], Decimal("200.00"), Decimal("900.00"))
    assert len(got[1].notes) == 1 and got[1].checked_at == day(2026, 1, 1)
    assert (got[2].min_days, got[2].max_days, got[2].terms, got[2].notes) == (60, 365, None, [])
    assert got[3].min_days == 91 and got[3].max_days is None


def test_card_terms_and_availability(spark):
    rows = spark.createDataFrame([("Обслуживание 150 ₽, кэшбэк до 5 %, не более 3 000 ₽ в месяц, 120 дней без процентов",), ("Бесплатное обслуживание",)], "t string")
    got = [r[0] for r in rows.select(facts.card_terms(F.col("t"))).collect()]
    assert (got[0].service, got[0].cashback_pct, got[0].cap, got[0].grace_days) == (150.0, 5.0, 3000.0, 120.0) and got[1].service == 0.0
    states = spark.createDataFrame([("local", "", None), ("federal", "selector", None), ("federal", None, "not here"), ("x", "", "")], "m string, s string, n string")
    assert [r.availability for r in facts.availability(states, "m", "s", "n").collect()] == ["local", "local", "absent", "unknown"]
