"""Product queries: ids in four levels, showcase cards by beginnings of titles, terms that changed between two runs, plausibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import products, quality
from ratelens.plans.registry import query
from ratelens.sources.tables import table

_ADDRESS = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '/personal/new' ELSE concat('/s', p_partkey % 3, '/t', p_partkey % 4, '/p', p_size % 23) END"
_LEVELS = ", ".join(
    f"""l{n} AS (SELECT id, bank, block, name FROM (SELECT *, s[least({n}, len(s))] AS name, count(*) OVER (PARTITION BY bank, block, s[least({n}, len(s))]) AS c FROM p{n}) x
      WHERE c = 1 AND NOT EXISTS (SELECT 1 FROM {{known}} k WHERE k.bank = x.bank AND k.block = x.block AND k.name = x.name)), k{n} AS (SELECT * FROM {{known}} UNION ALL SELECT * FROM l{n}), p{n + 1} AS (SELECT * FROM p{n} WHERE id NOT IN (SELECT id FROM l{n}))""".replace("{known}", f"k{n - 1}")
    for n in (1, 2, 3, 4)
)


@query(
    "product_ids_in_levels",
    f"""WITH a AS (SELECT p_partkey AS id, p_brand AS bank, 'B' || p_partkey % 2 AS block, {_ADDRESS} AS address, 'vklad-luchshiy-' || p_size AS t FROM part),
    p1 AS (SELECT id, bank, block, CASE WHEN address IS NULL OR address LIKE '%/new' THEN [t] ELSE [split_part(address, '/', 4), split_part(address, '/', 3) || '-' || split_part(address, '/', 4), replace(substr(address, 2), '/', '-'), t] END AS s FROM a),
    k0 AS (SELECT 0::BIGINT AS id, '' AS bank, '' AS block, '' AS name WHERE FALSE), {_LEVELS},
    n AS (SELECT *, s[len(s)] AS base, row_number() OVER (PARTITION BY bank, block, s[len(s)] ORDER BY id) AS r FROM p5),
    m AS (SELECT id, base, r + CASE WHEN EXISTS (SELECT 1 FROM k4 k WHERE k.bank = n.bank AND k.block = n.block AND k.name = n.base) THEN 1 ELSE 0 END AS r FROM n)
    SELECT id AS product_id, name FROM k4 UNION ALL SELECT id, base || CASE WHEN r > 1 THEN '-' || r ELSE '' END FROM m""",
)
def product_ids_in_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS bank", "concat('B', p_partkey % 2) AS block", f"{_ADDRESS} AS address", "concat('Вклад «Лучший ', p_size, '»') AS title")
    return products.product_ids(rows, "id", ["bank", "block"], "address", "title").withColumnRenamed("id", "product_id")


_PAGES = "SELECT p_partkey % 5 AS bank, p_partkey AS product, concat('Кредит «a', p_partkey % 13, '» b', p_size % 7, ' c', p_partkey % 3) AS title, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS rate_min, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1.5 END AS rate_max, p_partkey % 6 <> 0 AS has_page FROM part"
_CARDS = "SELECT s_suppkey % 5 AS bank, s_suppkey AS card, concat('КРЕДИТ A', s_suppkey % 17, CASE WHEN s_suppkey % 3 > 0 THEN concat(' b', s_suppkey % 7) ELSE '' END, CASE WHEN s_suppkey % 3 = 2 THEN concat(' c', s_suppkey % 4) ELSE '' END) AS title, s_suppkey % 19 + 0.5 AS rate_min, s_suppkey % 19 + 2.5 AS rate_max FROM supplier"


@query(
    "showcase_by_prefix",
    f"""WITH p AS (SELECT *, trim(regexp_replace(lower(regexp_replace(title, '[«»]', ' ', 'g')), '\\s+', ' ', 'g')) AS key FROM ({_PAGES})),
    c AS (SELECT * FROM (SELECT *, lower(title) AS key, row_number() OVER (PARTITION BY bank, lower(title) ORDER BY card) AS n FROM ({_CARDS})) WHERE n = 1),
    placed AS (SELECT c.*, coalesce((SELECT min(product) FROM p WHERE p.bank = c.bank AND p.key = c.key), (SELECT min(product) FROM p WHERE p.bank = c.bank AND p.has_page AND starts_with(p.key, c.key || ' '))) AS product FROM c),
    given AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank, product ORDER BY card) AS k FROM placed WHERE product IS NOT NULL) WHERE k = 1)
    SELECT p.bank, p.product, CASE WHEN p.rate_min IS NULL THEN g.card END AS card, p.title, coalesce(p.rate_min, g.rate_min)::DOUBLE AS rate_min, CASE WHEN p.rate_min IS NULL THEN g.rate_max ELSE p.rate_max END::DOUBLE AS rate_max, CASE WHEN p.rate_min IS NULL AND g.card IS NOT NULL THEN 'showcase' ELSE 'page' END AS source
    FROM p LEFT JOIN given g ON g.bank = p.bank AND g.product = p.product UNION ALL SELECT bank, NULL, card, title, rate_min::DOUBLE, rate_max::DOUBLE, 'card' FROM placed WHERE product IS NULL""",
)
def showcase_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = products.with_showcase(spark.sql(_PAGES.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part")), spark.sql(_CARDS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier")))
    return found.withColumn("rate_min", F.col("rate_min").cast("double")).withColumn("rate_max", F.col("rate_max").cast("double"))


@query(
    "terms_changed",
    """SELECT p_brand AS bank, p_partkey AS product, 'Срок' AS field, p_size || ' мес' AS old_value, (p_size + 1) || ' мес' AS new_value FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_brand, p_partkey, 'Сумма', p_type, upper(p_type || '!') FROM part WHERE p_partkey % 5 = 0""",
)
def terms_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of every part's terms: terms and sums change for some, rates for all, entries stand in another order."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    before = {"Ставка": F.col("p_size").cast("string"), "Срок": F.concat(F.col("p_size").cast("string"), F.lit(" мес")), "Сумма": F.col("p_type")}
    now = {"Сумма": F.when(k % 5 == 0, F.upper(F.concat("p_type", F.lit("!")))).otherwise(F.col("p_type")), "Срок": F.when(k % 3 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(" мес"))).otherwise(before["Срок"]), "Ставка": F.when(k % 2 == 0, F.lit("x")).otherwise(before["Ставка"]), "Новое": F.when(k % 7 == 0, F.lit("да"))}

    def run(terms: dict) -> DataFrame:
        made = F.map_filter(F.create_map(*[x for name, value in terms.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
        return part.select(F.col("p_brand").alias("bank"), k.alias("product"), made.alias("terms")).withColumn("fingerprint", products.terms_fingerprint(F.col("terms")))

    return products.term_changes(run(now), run(before))


_PLAUSIBLE = """SELECT p_partkey AS product, ['Вклады', 'Кредиты', 'Кредитные карты', 'Дебетовые карты', 'Ипотека'][p_partkey % 5 + 1] AS category,
  ['Вклад Рост', 'Кредит наличными', 'Семейная ипотека', 'Вклады для физических лиц', 'loans_new-1', 'Ипотека'][p_partkey % 6 + 1] AS title, CASE WHEN p_size % 4 > 0 THEN p_size * 2.5 END AS rate_min, CASE WHEN p_size % 3 > 0 THEN p_size * 2.5 + 1 END AS rate_max,
  CASE WHEN p_partkey % 7 = 1 THEN p_size * 2.5 - 0.5 WHEN p_partkey % 7 = 2 THEN p_size * 2.5 - 0.75 END AS apr_min, p_partkey % 13 = 0 AS unconfirmed, p_partkey % 17 = 0 AS absent, ['body', 'showcase', 'tariff', 'estimate'][p_partkey % 4 + 1] AS rate_source, p_partkey % 3 = 0 AS subsidised FROM part"""


@query(
    "product_plausibility",
    f"""WITH p AS ({_PLAUSIBLE}), f AS (SELECT *, category = 'Вклады' AS saves, category IN ('Кредиты', 'Кредитные карты', 'Ипотека') AS lends, coalesce(rate_min, rate_max) IS NOT NULL AS priced, least(rate_min, rate_max) AS low, greatest(rate_min, rate_max) AS high FROM p),
    i AS (SELECT product, list_filter([CASE WHEN (saves OR lends) AND NOT priced THEN 'no_rate' END, CASE WHEN unconfirmed THEN 'region_not_confirmed' END, CASE WHEN absent THEN 'not_in_region' END,
      CASE WHEN title = 'Вклады для физических лиц' OR title = category THEN 'section_page' END, CASE WHEN title = 'loans_new-1' THEN 'slug_title' END, CASE WHEN (saves OR lends) AND rate_source = 'showcase' THEN 'from_showcase' END, CASE WHEN rate_source = 'tariff' THEN 'from_tariff' END,
      CASE WHEN rate_source = 'estimate' THEN 'from_estimate' END, CASE WHEN (saves OR lends) AND (low <= 0 OR high >= 100) THEN 'rate_out_of_range' END, CASE WHEN saves AND high > 19 THEN 'savings_over_key' END,
      CASE WHEN lends AND title <> 'Семейная ипотека' AND low < 16 THEN 'credit_under_key' END, CASE WHEN (saves OR lends) AND category <> 'Кредитные карты' AND NOT subsidised AND apr_min < rate_min - 0.5 THEN 'cost_under_rate' END], lambda x: x IS NOT NULL) AS issues FROM f)
    SELECT product, array_to_string(issues, ',') AS issues, CASE WHEN len(list_intersect(issues, ['region_not_confirmed', 'not_in_region', 'section_page', 'rate_out_of_range', 'savings_over_key', 'credit_under_key', 'cost_under_rate'])) > 0 THEN 'low'
      WHEN len(list_intersect(issues, ['slug_title', 'from_showcase', 'from_tariff', 'from_estimate'])) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM i""",
)
def product_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a collected product, by all rules at a key rate of 16 %."""
    p, size = F.col("p_partkey"), F.col("p_size") * 2.5

    def pick(n: int, *values: str):
        return F.element_at(F.array(*map(F.lit, values)), (p % n).cast("int") + 1)

    rows = table(spark, sf_dir, "part").select(
        p.alias("product"),
        pick(5, "Вклады", "Кредиты", "Кредитные карты", "Дебетовые карты", "Ипотека").alias("category"),
        pick(6, "Вклад Рост", "Кредит наличными", "Семейная ипотека", "Вклады для физических лиц", "loans_new-1", "Ипотека").alias("title"),
        F.when(F.col("p_size") % 4 > 0, size).alias("rate_min"),
        F.when(F.col("p_size") % 3 > 0, size + 1).alias("rate_max"),
        F.when(p % 7 == 1, size - 0.5).when(p % 7 == 2, size - 0.75).alias("apr_min"),
        F.when(p % 13 == 0, "not_confirmed").otherwise("local").alias("region_method"),
        F.when(p % 17 == 0, "недоступна").alias("absent"),
        pick(4, "body", "showcase", "tariff", "estimate").alias("rate_source"),
        (p % 3 == 0).alias("subsidised"),
    )
    judged = quality.assess(rows, quality.product_rules(F.lit(16.0)))
    return judged.select("product", F.array_join("issues", ",").alias("issues"), "confidence")
