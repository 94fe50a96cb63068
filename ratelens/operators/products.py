"""Products as such: ids from their addresses, rates from showcase cards, and what changed in their terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.text import slug
from ratelens.operators.pages import title_key
from ratelens.sources.ranges import cut_numbered
from ratelens.sources.tables import cut, drop

# Last parts of an address that name no product.
WEAK_PARTS = ("", "index", "main", "online", "new", "person", "personal", "ru")
#: Levels of names, shortest first.
LEVELS = 4


def stems(address: Column, title: Column) -> Column:
    """Names for a product, shortest first: of its fragment, of the last 1, 2 and 3 parts of its path, of its title; never none."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(address, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][\w+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    strong = F.coalesce(~F.lower(F.try_element_at(parts, F.lit(-1))).isin(*WEAK_PARTS), F.lit(False))
    by_depth = [F.when(strong & (F.size(parts) >= d), slug(F.array_join(F.slice(parts, -d, d), "-"))) for d in (1, 2, 3)]
    named = F.array(slug(F.regexp_extract(F.coalesce(address, F.lit("")), "#(.+)$", 1)), *by_depth, slug(F.coalesce(title, F.lit(""))))
    found = F.filter(named, lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("product")))


def product_ids(products: DataFrame, id_col: str, within: list[str], address: str, title: str) -> DataFrame:
    """(id, name): for each product its shortest stem that no other one within the same columns (bank, block) claims.

    In four levels: those whose stem of a level is claimed once, and not taken at an earlier one, get it; the others go on to
    the next level. What is left gets its last stem with a number, counted in id order past names that are taken. Only
    products without a name move from level to level. The same products get the same names on every run, and an address keeps
    its name when the title changes. Ids are unique.
    """
    pending = cut(products.select(F.col(id_col).alias("id"), *within, stems(F.col(address), F.col(title)).alias("stems")), "product-stems")
    taken: list[DataFrame] = []
    for level in range(LEVELS):
        name = F.get("stems", F.least(F.lit(level), F.size("stems") - 1))
        claims = pending.withColumn("name", name)
        single = claims.groupBy(*within, "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")
        for earlier in taken:
            single = _without(single, earlier, within)
        won = cut(single.select("id", *within, "name"), "product-names")
        taken.append(won)
        rest = cut(pending.join(won.select("id"), "id", "left_anti"), "product-stems")
        drop(pending)
        pending = rest
    # What is left is numbered: places in one order of all, less the place of its name's first; numbers that levels took are stepped over.
    left = cut_numbered(pending.select("id", *within, F.try_element_at("stems", F.lit(-1)).alias("base")), [*[F.col(c).asc_nulls_first() for c in within], F.col("base"), F.col("id")], "place", "product-left")
    drop(pending)
    named = reduce(DataFrame.unionByName, taken)
    forms = named.select(*within, F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"-[0-9]+$", "")))).alias("base"), "name")
    number = F.when(F.col("name") == F.col("base"), 1).otherwise(F.substr("name", F.length("base") + 2).try_cast("long"))
    after = 0
    while not left.isEmpty():
        starts = left.groupBy(*within, "base").agg(F.min("place").alias("start"))
        used = forms.join(_renamed(starts.drop("start")), _pairs(forms, [*within, "base"]), "left_semi").groupBy(*within, "base").agg(F.array_sort(F.collect_set(number)).alias("used"))
        starts = starts.join(_renamed(used), _pairs(starts, [*within, "base"]), "left").select(*within, "base", "start", F.coalesce("__used", F.array().cast("array<bigint>")).alias("used"))
        rows = left.join(_renamed(starts), _pairs(left, [*within, "base"]))
        rank = F.col("place") - F.col("__start") + 1 + after
        n = F.aggregate("__used", rank, lambda n, u: F.when(u <= n, n + 1).otherwise(n))
        offered = rows.select("id", *within, "base", "place", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("name"))
        # Numbered names of different stems may meet: the first product keeps it, the others are numbered again, beyond all of this round.
        first = offered.groupBy(*within, "name").agg(F.min("id").alias("id"))
        for earlier in taken[LEVELS:]:
            first = _without(first, earlier, within)
        won = cut(first.select("id", *within, "name"), "product-names")
        after += left.count()
        rest = cut(left.join(won.select("id"), "id", "left_anti"), "product-left")
        drop(left)
        taken.append(won)
        left = rest
    drop(left)
    return reduce(DataFrame.unionByName, taken).select("id", "name")


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[f"__{c}" for c in rows.columns])


def _pairs(rows: DataFrame, columns: list[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & rows[c].eqNullSafe(F.col(f"__{c}"))
    return test


def _without(rows: DataFrame, known: DataFrame, within: list[str]) -> DataFrame:
    return rows.join(known.select(*[F.col(c).alias(f"__{c}") for c in [*within, "name"]]), _pairs(rows, [*within, "name"]), "left_anti")


def with_showcase(products: DataFrame, cards: DataFrame) -> DataFrame:
    """Products with what a bank's showcase says of them, and a product for each card that has no page.

    products: bank, product, title, rate_min, rate_max, has_page (of their own); cards: bank, card, title, rate_min, rate_max. A card belongs to the
    product of its title; without one to the first product with a page whose title goes on after the card's, word by word.
    A product without a rate takes that of its first card. Returns bank, product, card, title, rate_min, rate_max, source (page, showcase, card).

    Titles' first words are keys: a product has as many as its title has words, of which each bank's first product for a key is
    kept, so a common beginning is one row and the join is by equal keys.
    """
    keyed = products.withColumn("key", title_key(F.col("title")))
    shown = cards.withColumn("key", title_key(F.col("title"))).groupBy("bank", "key").agg(F.min_by(F.struct("card", "title", "rate_min", "rate_max"), "card").alias("c")).select("bank", "key", "c.*")
    words = F.split("key", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    longer = keyed.where(F.col("has_page") & F.contains("key", F.lit(" "))).select("bank", "product", F.explode(starts).alias("key"))
    first = longer.groupBy("bank", "key").agg(F.min("product").alias("product"), F.lit(1).alias("rank"))
    exact = keyed.groupBy("bank", "key").agg(F.min("product").alias("product"), F.lit(0).alias("rank"))
    best = exact.unionByName(first).groupBy("bank", "key").agg(F.min_by("product", "rank").alias("product"))
    placed = shown.join(best, ["bank", "key"], "left")
    given = placed.where("product IS NOT NULL").groupBy("bank", "product").agg(F.min_by(F.struct("card", "rate_min", "rate_max"), "card").alias("c"))
    rated = keyed.join(given, ["bank", "product"], "left")
    takes = F.col("rate_min").isNull() & F.col("c").isNotNull()
    own = rated.select("bank", "product", F.when(takes, F.col("c.card")).alias("card"), "title", F.when(takes, F.col("c.rate_min")).otherwise(F.col("rate_min")).alias("rate_min"), F.when(takes, F.col("c.rate_max")).otherwise(F.col("rate_max")).alias("rate_max"), F.when(takes, "showcase").otherwise("page").alias("source"))
    alone = placed.where("product IS NULL").select("bank", F.lit(None).cast(products.schema["product"].dataType).alias("product"), "card", "title", "rate_min", "rate_max", F.lit("card").alias("source"))
    return own.unionByName(alone)


def terms_fingerprint(terms: Column, *parts: Column) -> Column:
    """One digest of a map of terms and further values: the same whatever the order of the map's entries; null and empty differ from any text."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(terms, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.sha2(F.to_json(F.struct(F.array(*[p.cast("string") for p in parts]).alias("p"), entries.alias("e")), {"ignoreNullFields": "false"}), 256)


def term_changes(now: DataFrame, before: DataFrame, size: int = 300) -> DataFrame:
    """(bank, product, field, old_value, new_value) of terms that have another value; rates are judged elsewhere, new terms aren't changes.

    now, before: bank, product, terms, fingerprint. Maps are opened only where the fingerprints differ.
    """
    a = now.select("bank", "product", "terms", "fingerprint")
    b = before.select("bank", "product", F.col("terms").alias("old"), F.col("fingerprint").alias("old_fingerprint"))
    differ = a.join(b, ["bank", "product"]).where(~F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")))
    each = differ.select("bank", "product", "old", F.explode("terms").alias("field", "new_value")).withColumn("old_value", F.try_element_at("old", F.col("field")))
    changed = each.where(F.col("old_value").isNotNull() & F.col("new_value").isNotNull() & (F.col("old_value") != F.col("new_value")) & ~F.startswith(F.lower("field"), F.lit("ставка")))
    return changed.select("bank", "product", "field", F.left("old_value", F.lit(size)).alias("old_value"), F.left("new_value", F.lit(size)).alias("new_value"))
