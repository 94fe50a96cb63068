"""Product ids, showcase cards, fingerprints and changed terms, against walks over all products."""

import random

from pyspark.sql import functions as F

from ratelens.functions.text import CYRILLIC
from ratelens.operators import products


def slug(t, size=40):
    import re

    return re.sub("[^a-z0-9]+", "-", "".join(CYRILLIC.get(c, c) for c in t.lower())).strip("-")[:size].strip("-")


def stems(address, title):
    import re

    path = re.sub(r"^[A-Za-z][\w+.-]*://[^/]*", "", re.sub(r"[?#].*$", "", address or ""))
    parts = [p for p in path.split("/") if p]
    found = [slug(address.split("#", 1)[1])] if address and "#" in address else []
    if parts and parts[-1].lower() not in products.WEAK_PARTS:
        found += [slug("-".join(parts[-d:])) for d in (1, 2, 3) if len(parts) >= d]
    return [s for s in [*found, slug(title or "")] if s] or ["product"]


def ids_of(rows):
    out, groups = {}, {}
    for r in sorted(rows):
        groups.setdefault(r[1:3], []).append(r)
    for group in groups.values():
        taken = set()
        for level in range(4):
            names = {}
            for r in group:
                if r[0] not in out:
                    s = stems(r[3], r[4])
                    names.setdefault(s[min(level, len(s) - 1)], []).append(r[0])
            for name, owners in names.items():
                if len(owners) == 1 and name not in taken:
                    out[owners[0]] = name
                    taken.add(name)
        for r in group:
            if r[0] not in out:
                base = stems(r[3], r[4])[-1]
                name, n = base, 2
                while name in taken:
                    name, n = f"{base}-{n}", n + 1
                out[r[0]] = name
                taken.add(name)
    return out


SCHEMA = "id long, bank string, block string, address string, title string"


def test_ids_are_the_shortest_that_are_free(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        depth = rng.randrange(0, 4)
        address = "/" + "/".join(rng.choice(["vklad", "kredit", "new", "Акция", "x1"]) for _ in range(depth)) + rng.choice(["", "", "#вклад «доход»", "?utm=1"])
        rows.append((i, rng.choice(["A", "B", None]), rng.choice(["DEP", "CARD"]), rng.choice([address, address, None]), rng.choice(["Вклад «Лучший»", "Кредит", "x1", "Щука", "", None])))
    got = {r.id: r["name"] for r in products.product_ids(spark.createDataFrame(rows, SCHEMA), "id", ["bank", "block"], "address", "title").collect()}
    assert got == ids_of([(r[0], str(r[1]), *r[2:]) for r in rows])
    assert len({(r[1], r[2], got[r[0]]) for r in rows}) == len(rows)
    # Where a title is another one's with a number, ids are unique still.
    rows = [(i, "A", "DEP", None, "x1" if i % 3 else "x1-2") for i in range(30)]
    ids = products.product_ids(spark.createDataFrame(rows, SCHEMA), "id", ["bank", "block"], "address", "title").collect()
    assert len({r["name"] for r in ids}) == 30 and all(r["name"].startswith("x1") for r in ids)
    assert products.product_ids(spark.createDataFrame([], SCHEMA), "id", ["bank"], "address", "title").collect() == []


def test_an_address_keeps_its_id(spark):
    address = "/ru/person/contributions/deposits/vklad_luchshiy"
    rows = [(1, "A", "DEP", address, "Вклад «Лучший %»"), (2, "B", "DEP", address, "Вклад «Лучший процент»"), (3, "C", "CARD", "/cards/debit/karta", "Карта"), (4, "C", "CARD", "/cards/credit/karta", "Кредитная карта"), (5, "D", "DEP", "https://d.ru/deposits#вклад «классика»", "x"), (6, "D", "DEP", "https://d.ru/deposits#вклад «доход»", "y")]
    got = {r.id: r["name"] for r in products.product_ids(spark.createDataFrame(rows, SCHEMA), "id", ["bank", "block"], "address", "title").collect()}
    assert got == {1: "vklad-luchshiy", 2: "vklad-luchshiy", 3: "debit-karta", 4: "credit-karta", 5: "vklad-klassika", 6: "vklad-dokhod"}


def test_showcase(spark):
    pages = [("A", 1, "Кредит на образование с господдержкой", None, None, True), ("A", 2, "Кредит на образование", 5.0, 5.0, False), ("A", 3, "Вклад «Рост»", None, None, True), ("A", 4, "Карта мир", 3.0, 4.0, True), ("A", 5, "Кредит на авто новый", None, None, True), ("A", 6, "Кредит на авто старый", None, None, True), ("B", 7, "Кредит на авто", None, None, True)]
    cards = [("A", 10, "кредит на образование", 9.0, 9.0), ("A", 11, "ВКЛАД РОСТ", 14.0, 15.0), ("A", 12, "Карта", 1.0, 1.0), ("A", 13, "Кредит на авто", 17.0, 18.0), ("A", 14, "Нигде", 2.0, 2.0), ("A", 15, "вклад рост", 1.0, 1.0), ("A", 16, "Кредит на ав", 8.0, 8.0)]
    got = products.with_showcase(spark.createDataFrame(pages, "bank string, product int, title string, rate_min double, rate_max double, has_page boolean"), spark.createDataFrame(cards, "bank string, card int, title string, rate_min double, rate_max double"))
    rows = {(r["product"], r.card): (r.rate_min, r.source) for r in got.collect()}
    assert rows == {(1, None): (None, "page"), (2, None): (5.0, "page"), (3, 11): (14.0, "showcase"), (4, None): (3.0, "page"), (5, 13): (17.0, "showcase"), (6, None): (None, "page"), (7, None): (None, "page"), (None, 14): (2.0, "card"), (None, 16): (8.0, "card")}


def test_fingerprints_and_terms(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": None}, "x"), (2, {"b": None, "a": "1"}, "x"), (3, {"a": "1"}, "x"), (4, {"a": "1", "b": ""}, "x"), (5, None, "x"), (6, {}, "x"), (7, {}, None), (8, {}, "")], "i int, t map<string,string>, p string")
    f = {r.i: r.f for r in rows.select("i", products.terms_fingerprint(F.col("t"), F.col("p")).alias("f")).collect()}
    assert f[1] == f[2] and f[5] == f[6] and len(set(f.values())) == 6
    now = spark.createDataFrame([("b", 1, {"Срок": "2 года", "Ставка": "5", "Новое": "x", "Сумма": "1"}, "n"), ("b", 2, {"Срок": "1"}, "same")], "bank string, product int, terms map<string,string>, fingerprint string")
    old = spark.createDataFrame([("b", 1, {"Срок": "1 год", "Ставка": "4", "Сумма": "1"}, "o"), ("b", 2, {"Срок": "2"}, "same")], "bank string, product int, terms map<string,string>, fingerprint string")
    assert [tuple(r) for r in products.term_changes(now, old).collect()] == [("b", 1, "Срок", "1 год", "2 года")]
