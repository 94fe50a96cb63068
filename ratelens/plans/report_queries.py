"""Promotion, availability, scenario and report queries.

Texts and paths are short fixed lists, spread over the parts by their key; numbers come from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.functions import formats, text
from ratelens.operators import availability, digest, market, promotions, quality, reports, scenarios, snapshots
from ratelens.plans.registry import query
from ratelens.sources.tables import table

_TITLES = """titles AS (SELECT * FROM (VALUES
  (0, '/personal/debetcards/mir', 'Кешбэк на покупки'), (1, '/personal/unknown/x', 'Кредитная карта с бонусом'), (2, '/personal', 'Карта Мир: скидки'),
  (3, '/promo/a', 'Новый тариф карты'), (4, NULL, 'Юридическая консультация по ипотеке'), (5, '/a/b', 'Что такое акции'), (6, '/personal/saving/top', 'Вклад под 18 %'),
  (7, '/x', 'Депозит для пенсионеров'), (8, '', 'Подарок за друга'), (9, '/x/y', 'Двойные баллы весь месяц'), (10, '/personal/loans', 'Правила программы'),
  (11, 'personal/mortgage/new', NULL), (12, '/promo', 'Страхование путешествий'), (13, '/promo', '  ')) AS t(i, path, title)),
kinds AS (SELECT * FROM (VALUES (0, 'cashback', '%'), (1, 'rate', '%'), (2, 'discount', 'rub'), (3, 'prize', 'rub'), (4, 'points', 'pts'), (5, 'other', ''), (6, 'money', 'rub'), (7, 'discount', '%')) AS t(k, kind, unit)),
promos AS (SELECT p_partkey AS promo, path, title, p_brand AS bank, p_type AS segment, kind, unit, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS value
  FROM {part} JOIN titles ON p_partkey % 14 = i JOIN kinds ON (p_partkey * 7 + p_size) % 8 = k)"""
PROMOS = _TITLES.replace("{part}", "part")


def _promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_TITLES} SELECT * FROM promos", part=table(spark, sf_dir, "part"))


_SURE = "(kind <> 'prize')"


@query(
    "promo_segments",
    f"""WITH {PROMOS}, parts AS (SELECT *, list_filter(string_split(coalesce(path, ''), '/'), lambda x: x <> '') AS p, lower(coalesce(title, '')) AS t FROM promos)
    SELECT promo, trim(t) <> '' AND NOT regexp_matches(trim(t), '^(что такое|когда растут|правила|тариф|условия обслуживания|информация)') AS offered,
      coalesce(CASE WHEN p[1] = 'personal' THEN CASE p[2] WHEN 'debetcards' THEN 'Дебетовые карты' WHEN 'saving' THEN 'Вклады' WHEN 'loans' THEN 'Кредиты' WHEN 'mortgage' THEN 'Ипотека' END END,
      CASE WHEN regexp_matches(t, 'тариф[а-яё]*\\s+карт') THEN 'Банковские карты' WHEN regexp_matches(t, 'консультац|юридическ|правокард|налог|госуслуг') THEN 'Сервисы и услуги'
        WHEN regexp_matches(t, 'кредитн[а-яё]*\\s+карт') THEN 'Кредитные карты' WHEN regexp_matches(t, 'дебетов[а-яё]*\\s+карт|карт[аоуы]\\s+«?мир') THEN 'Дебетовые карты' WHEN regexp_matches(t, 'зарплатн') THEN 'Зарплатные карты'
        WHEN regexp_matches(t, 'пенси') THEN 'Пенсионные продукты' WHEN regexp_matches(t, 'ипотек') THEN 'Ипотека' WHEN regexp_matches(t, 'кредит') THEN 'Кредиты' WHEN regexp_matches(t, 'вклад|депозит') THEN 'Вклады'
        WHEN regexp_matches(t, 'накопительн') THEN 'Накопительные счета' WHEN regexp_matches(t, 'инвест|брокер|облигац') THEN 'Инвестиции' WHEN regexp_matches(t, 'страхов') THEN 'Страхование'
        WHEN kind IN ('cashback', 'points', 'discount') OR regexp_matches(t, 'кешб[эе]к|кэшб[эе]к|бонус|балл|покупк') THEN 'Кешбэк и бонусные программы' ELSE 'Прочие предложения' END) AS segment FROM parts""",
)
def promo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return _promos(spark, sf_dir).select("promo", promotions.is_offer(title).alias("offered"), promotions.segment(F.col("path"), title, F.lit(""), F.col("kind")).alias("segment"))


@query("promo_best_values", f"WITH {PROMOS} SELECT segment, bank, kind, unit, max(value) AS best_value FROM promos WHERE {_SURE} AND value IS NOT NULL GROUP BY 1, 2, 3, 4")
def promo_best_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.best_values(_promos(spark, sf_dir), "segment", "bank")


@query(
    "promo_headline",
    f"""WITH {PROMOS}, h AS (SELECT *, list_position(['cashback%', 'rate%', 'discount%', 'cashbackrub', 'moneyrub', 'discountrub', 'pointspts'], kind || unit) AS r FROM promos),
    n AS (SELECT *, row_number() OVER (PARTITION BY segment, bank ORDER BY CASE WHEN value IS NOT NULL AND {_SURE} AND r IS NOT NULL THEN r WHEN {_SURE} THEN 100 ELSE 101 END,
      CASE WHEN value IS NOT NULL AND {_SURE} AND r IS NOT NULL THEN -value ELSE 0 END, promo) AS n FROM h) SELECT segment, bank, promo, kind, unit, value FROM n WHERE n = 1""",
)
def promo_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.headline(_promos(spark, sf_dir), ["segment", "bank"], "promo")


@query("promo_order", f"WITH {PROMOS} SELECT promo, bank, row_number() OVER (PARTITION BY bank ORDER BY CASE WHEN {_SURE} THEN 0 ELSE 1 END, coalesce(value, 0) DESC, title NULLS FIRST, promo) AS place FROM promos")
def promo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.in_show_order(_promos(spark, sf_dir), "bank", "promo").select("promo", "bank", F.col("place").cast("long").alias("place"))


@query(
    "segment_order",
    """WITH s AS (SELECT p_brand AS bank, p_type AS segment, count(*) AS total, ['red', 'yellow', 'green', 'grey'][CAST(sum(p_size) % 4 AS INT) + 1] AS verdict FROM part GROUP BY 1, 2)
    SELECT bank, segment, verdict, row_number() OVER (PARTITION BY bank ORDER BY CASE verdict WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 WHEN 'green' THEN 2 ELSE 3 END, total DESC, segment) AS place FROM s""",
)
def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bank"), F.col("p_type").alias("segment")).agg(F.count("*").alias("total"), F.sum("p_size").alias("sizes"))
    rows = rows.withColumn("verdict", F.get(F.array(*map(F.lit, promotions.VERDICTS)), (F.col("sizes") % 4).cast("int")))
    return promotions.in_verdict_order(rows, "bank").select("bank", "segment", "verdict", F.col("place").cast("long").alias("place"))


_EVIDENCE = """evidence AS (SELECT * FROM (VALUES (0, 'Не предоставляется в ЛНР', NULL, 'selector', 'src'), (1, NULL, 'Луганск: 18 % годовых', 'federal', NULL), (2, '', 'Луганск: недоступно', 'selector', NULL),
  (3, NULL, 'Луганск, регион не выбран: 5%', 'local', NULL), (4, NULL, NULL, 'federal', 'src'), (5, NULL, '', 'federal', ''), (6, NULL, '5%', 'not_confirmed', 'src'), (7, NULL, NULL, NULL, NULL)) AS t(i, absent, calculator, method, presence))"""


@query(
    "availability_status",
    f"""WITH {_EVIDENCE}, c AS (SELECT p_partkey, CASE WHEN coalesce(absent, '') <> '' THEN 'absent/page' WHEN calculator NOT LIKE '%регион не выбран%' AND lower(calculator) LIKE '%луганск%' AND regexp_matches(calculator, '[0-9]\\s?%') THEN 'lnr/calculator'
      WHEN method = 'selector' THEN 'lnr/selector' WHEN method = 'local' THEN 'lnr/local' WHEN method = 'federal' AND presence <> '' THEN 'federal/presence' WHEN method = 'federal' THEN 'unknown/no_presence' ELSE 'unknown/region_not_chosen' END AS s FROM part JOIN evidence ON p_partkey % 8 = i)
    SELECT p_partkey AS product, split_part(s, '/', 1) AS code, split_part(s, '/', 2) AS reason FROM c""",
)
def availability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {_EVIDENCE} SELECT * FROM {{part}} JOIN evidence ON p_partkey % 8 = i", part=table(spark, sf_dir, "part"))
    found = rows.withColumn("s", availability.status(*map(F.col, ("absent", "calculator", "method", "presence"))))
    return found.select(F.col("p_partkey").alias("product"), F.col("s.code").alias("code"), F.col("s.reason").alias("reason"))


_TAGGED = """tagged AS (SELECT p_partkey AS product, p_type AS program, p_brand AS bank, p_size AS rate, tags, CASE WHEN p_partkey % 5 = 0 THEN 'welcome' WHEN p_partkey % 5 < 4 THEN 'base' END AS kind, CASE WHEN p_size % 10 = 0 THEN 'нет' END AS absent
  FROM {part} JOIN (VALUES (0, ''), (1, 'вклад,ип'), (2, 'карта,прем'), (3, 'иностр'), (4, 'рефин'), (5, 'комбо')) AS t(i, tags) ON p_partkey % 6 = i)"""


@query(
    "program_representatives",
    f"""WITH {_TAGGED.replace("{part}", "part")} SELECT program, bank, count(*) AS products, max(rate) AS rate FROM tagged WHERE NOT regexp_matches(tags, '(^|,)(иностр|ип|гараж|комб|номинал|пакет|ислам|пушкин|стикер)(,|$)')
    AND coalesce(kind, 'base') = 'base' AND absent IS NULL AND program <> 'PROMO' GROUP BY 1, 2""",
)
def program_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {_TAGGED} SELECT * FROM tagged", part=table(spark, sf_dir, "part"))
    kept = availability.representative(rows, F.split("tags", ","), F.col("kind"), F.col("absent"), ("PROMO",))
    return kept.groupBy("program", "bank").agg(F.count("*").alias("products"), F.max("rate").alias("rate"))


@query(
    "rate_range_text",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 2) THEN least(p_size, b) WHEN p_partkey % 6 = 3 THEN p_size WHEN p_partkey % 6 = 1 THEN NULL END AS low,
      CASE WHEN p_partkey % 6 IN (0, 2) THEN greatest(p_size, b) WHEN p_partkey % 6 = 1 THEN p_size END AS high FROM (SELECT *, (p_partkey % 30) + 0.5 AS b FROM part)""",
)
def rate_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("string"), F.concat((F.col("p_partkey") % 30).cast("string"), F.lit(",5"))
    case = F.col("p_partkey") % 6
    said = F.when(case == 0, F.concat(F.lit("От "), a, F.lit("% до "), b, F.lit("%"))).when(case == 1, F.concat(F.lit("До "), a, F.lit(" % годовых"))).when(case == 2, F.concat(b, F.lit(" – "), a, F.lit(" %")))
    said = said.when(case == 3, F.concat(F.lit("от "), a, F.lit("%"))).when(case == 4, F.concat(a, F.lit(" без процентов"))).otherwise(F.concat(a, F.lit("%, "), b, F.lit("%, "), a, F.lit("%")))
    return table(spark, sf_dir, "part").withColumn("r", text.rate_range(said)).select("p_partkey", F.col("r.low").alias("low"), F.col("r.high").alias("high"))


@query(
    "money_and_terms_text",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size * 1000000, ',', (p_size + 1) * 1000000) WHEN 1 THEN concat(30000 + p_size, ',', p_size * 1000000) WHEN 2 THEN '' ELSE concat(p_size * 1000 + 999, '') END AS sums,
      CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ',', p_size + 12) WHEN 1 THEN concat(greatest(1, round_even(p_size / 30, 0)::INT), '') WHEN 2 THEN concat(p_size * 12, '') ELSE '' END AS months FROM part""",
)
def money_and_terms_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    def said(*cases: str):
        n = [F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 12]
        out = F.when(F.lit(False), "")
        for i, form in enumerate(cases):
            out = out.when(F.col("p_partkey") % 4 == i, F.format_string(form, *n))
        return out

    sums = text.money_list(said("от %1$d до %2$d млн ₽", "От 30 %1$03d до %1$d млн рублей", "%1$d тыс", "%1$d 999 руб. в 3 этапа"))
    terms = text.term_months(said("от %1$d до %3$d мес.", "%1$d дней", "%1$d лет", "пункт %1$d"))
    whole = {c: F.array_join(F.transform(v, lambda x: x.cast("long").cast("string")), ",") for c, v in (("sums", sums), ("months", terms))}
    return table(spark, sf_dir, "part").select("p_partkey", whole["sums"].alias("sums"), whole["months"].alias("months"))


@query(
    "formatted_values",
    """WITH v AS (SELECT o_orderkey, o_custkey % 130 AS n, floor(o_totalprice)::DOUBLE + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.25 END AS x, (o_orderkey % 400) / 8 AS p, o_orderdate FROM orders)
    SELECT o_orderkey, replace(replace(regexp_replace(format('{:,.2f}', x), '[.]00$', ''), ',', ' '), '.', ',') || ' ₽' AS money,
      replace(regexp_replace(regexp_replace(printf('%.6f', p), '0+$', ''), '[.]$', ''), '.', ',') || '%' AS percent, replace(printf('%.2f', x), '.', ',') || ' п.п.' AS points,
      CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'акций' WHEN n % 10 = 1 THEN 'акция' WHEN n % 10 BETWEEN 2 AND 4 THEN 'акции' ELSE 'акций' END AS noun,
      strftime(o_orderdate::TIMESTAMP + INTERVAL 27 HOUR, '%d.%m.%Y %H:%M МСК') AS at FROM v""",
)
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.floor("o_totalprice").cast("double") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(0.25)
    at = F.to_timestamp(F.col("o_orderdate")) + F.expr("INTERVAL 24 HOURS")
    noun = formats.plural(F.col("o_custkey") % 130, "акция", "акции", "акций")
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.money(x).alias("money"), formats.percent(F.col("o_orderkey") % 400 / 8).alias("percent"), formats.points(x).alias("points"), noun.alias("noun"), formats.moscow(at).alias("at"))


SEVERITIES = ("low", "medium", "high")
_CHANGES = "changes AS (SELECT n_name AS bank, l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS severity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events with their product's bank: lines, suppliers, nations."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    banks = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("bank"))
    severity = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return lines.join(banks, "l_suppkey").select("bank", "l_orderkey", "l_linenumber", "l_partkey", severity.alias("severity"))


@query("changes_in_severity_order", f"WITH {_CHANGES} SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, l_linenumber, l_partkey, bank) AS place FROM changes")
def changes_in_severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.in_severity_order(_changes(spark, sf_dir), SEVERITIES, "l_orderkey", "l_linenumber", "l_partkey", "bank").withColumn("place", F.col("place").cast("long"))


@query("changes_at_least_medium", f"WITH {_CHANGES} SELECT bank, severity, count(*) AS n FROM changes WHERE severity IN ('medium', 'high') GROUP BY 1, 2")
def changes_at_least_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.at_least(_changes(spark, sf_dir), SEVERITIES, "medium").groupBy("bank", "severity").agg(F.count("*").alias("n"))


@query("highest_severity", f"WITH {_CHANGES} SELECT l_orderkey, count(*) AS changes, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM changes GROUP BY 1")
def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.highest_severity(_changes(spark, sf_dir), SEVERITIES, "l_orderkey")


@query(
    "parameter_coverage",
    """WITH planned AS (SELECT DISTINCT p_brand, p_size FROM part), have AS (SELECT DISTINCT p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45)
    SELECT p_brand, count(*) AS planned, count(h.p_size) AS collected, round(100.0 * count(h.p_size) / count(*), 1) AS coverage_pct FROM planned LEFT JOIN have h USING (p_brand, p_size) GROUP BY 1""",
)
def parameter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_quantity") > 45, F.col("l_quantity")).alias("value"))
    return quality.parameter_coverage(part, lines.join(part, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "p_size")


@query("collection_status", "SELECT l_orderkey, count(*) AS sources, count_if(l_discount < 0.05) AS failed, CASE WHEN count_if(l_discount < 0.05) = count(*) THEN 'failed' WHEN count_if(l_discount < 0.05) > 0 THEN 'partial' ELSE 'ok' END AS status FROM lineitem GROUP BY 1")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.collection_status(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") >= 0.05).alias("ok")), "l_orderkey")


@query("provenance_check", "SELECT l_orderkey, count(*) AS documents, count_if(p_partkey IS NULL) AS unknown, count_if(p_partkey IS NULL) = 0 AS complete FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return quality.unknown_documents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), known, "l_orderkey", "l_partkey")


@query("new_candidates", "SELECT user_id, event_type, min(ts) AS first_seen, count(*) AS seen, min(ts) >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS is_new FROM events GROUP BY 1, 2")
def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    newest = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since")).first()
    return digest.new_since(rows, ["user_id", "event_type"], "ts", F.lit(newest["since"]))


@query(
    "merged_groups",
    """WITH m AS (SELECT conv_id, arg_min(turn, (-length(coalesce(text, '')), turn)) AS main, max(length(text)) AS score, count(*) AS posts FROM conversations GROUP BY 1),
    f AS (SELECT conv_id, role, min(turn) AS p FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2), l AS (SELECT conv_id, string_agg(role, ',' ORDER BY p, role) AS labels FROM f GROUP BY 1) SELECT * FROM m LEFT JOIN l USING (conv_id)""",
)
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    return digest.merge_groups(posts, "conv_id", "turn", "text", "role", "size").withColumn("labels", F.array_join("labels", ","))


@query("dashboard_kpi", "SELECT user_id, count(*) AS events, count(CASE WHEN event_id % 4 = 0 AND user_id % 3 > 0 THEN value END) AS known, round(sum(CASE WHEN event_id % 4 = 0 AND user_id % 3 > 0 THEN value END), 2) AS total FROM events GROUP BY 1")
def dashboard_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.totals_known(table(spark, sf_dir, "events"), F.when((F.col("event_id") % 4 == 0) & (F.col("user_id") % 3 > 0), F.col("value")), "user_id")


@query("digest_category_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def digest_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("category")).agg(F.count("*").alias("n"))


@query(
    "report_top_news",
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_id % 5 + 1 AS score, CASE WHEN event_id % 3 = 0 THEN user_id END AS image FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, image IS NULL, event_id) AS place FROM e WHERE score >= 3)
    SELECT day, event_id, score, place FROM r WHERE place <= 7""",
)
def report_top_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", (F.col("event_id") % 5 + 1).alias("score"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("image"))
    return digest.top_news(rows, "day", 3, 7, "event_id").select("day", "event_id", "score", F.col("place").cast("long").alias("place"))


@query("newest_per_channel", "WITH r AS (SELECT event_type AS channel, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT * FROM r WHERE place <= 20")
def newest_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 20 newest posts of each channel."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "event_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 20")


@query(
    "blocked_goals",
    """SELECT o_custkey AS goal, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'недоступно' END, o_orderkey) AS note, count(*) AS options FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT LIKE '1%'
    GROUP BY 1 HAVING bool_and(o_orderstatus <> 'O')""",
)
def blocked_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = F.when(F.col("o_orderstatus") == "O", True).otherwise(False)
    options = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("goal"), "o_orderkey", available.alias("available"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"), F.col("o_orderpriority").startswith("1").alias("no_region"))
    return scenarios.blocked_goals(options, "goal", "o_orderkey")


@query(
    "scenario_warnings",
    """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_partkey % 5 = 0 THEN 'only_upper_rate' END, CASE WHEN l_partkey % 5 > 1 THEN 'rate_range' END, CASE WHEN l_returnflag = 'A' THEN 'floating_rate' END, CASE WHEN l_returnflag = 'R' THEN 'limited_time' END,
      CASE WHEN l_suppkey % 2 = 0 THEN 'region_not_confirmed' END, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_quantity > 7 THEN 'stale' END, CASE WHEN l_linenumber = 3 THEN 'unknown_date' END) AS warnings FROM lineitem""",
)
def scenario_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_partkey") % 5 > 1, 4.0).otherwise(5.0)
    flags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "A", "floating_rate"), F.when(F.col("l_returnflag") == "R", "limited_time")))
    confirmed, days = F.when(F.col("l_suppkey") % 2 == 1, True), F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(scenarios.warnings(days, low, F.lit(5.0), confirmed, flags), ";").alias("warnings"))


_SPECS = """specs AS (SELECT p_partkey, product, CAST(p_retailprice * 100 AS DOUBLE) AS amount, 12 + p_size AS months, CASE WHEN p_partkey % 9 > 0 THEN 1.0E0 * (p_size % 20) + 1 END AS rate, p_partkey % 3 = 0 AS capitalisation, CASE WHEN p_partkey % 8 > 0 THEN 5.5E0 END AS base_rate,
  CAST(p_size % 4 AS INT) AS welcome_months, CASE WHEN p_size % 5 > 0 THEN 14.0E0 END AS welcome_rate, 30000.0E0 AS spend, 1.5E0 AS cashback_pct, CASE WHEN p_size % 6 > 0 THEN 400.0E0 END AS cashback_limit, 3.0E0 AS balance_rate, CAST(p_size AS DOUBLE) AS monthly_fee,
  3.9E0 AS cash_fee_pct, 390.0E0 AS cash_fee_min, CASE WHEN p_size % 7 > 0 THEN 120 END AS grace_days, 20.0E0 AS down_payment_pct, CASE WHEN p_size % 11 > 0 THEN 1.0E0 * (p_size % 30) END AS down_payment_min_pct, 150000.0E0 AS amount_max
  FROM {part} JOIN (VALUES (0, 'deposit'), (1, 'savings_account'), (2, 'debit_card'), (3, 'credit_card'), (4, 'cash_loan'), (5, 'car_loan'), (6, 'mortgage'), (7, 'broker')) AS t(i, product) ON p_partkey % 8 = i)"""


@query(
    "scenario_dispatch",
    f"""WITH {_SPECS.replace("{part}", "part")}, m AS (SELECT *, CASE product WHEN 'deposit' THEN CASE WHEN rate IS NULL THEN 'rate' ELSE '' END
        WHEN 'savings_account' THEN CASE WHEN base_rate IS NULL THEN 'base_rate' WHEN welcome_months > 0 AND welcome_rate IS NULL THEN 'welcome_rate' ELSE '' END WHEN 'debit_card' THEN CASE WHEN cashback_limit IS NULL THEN 'cashback_limit' ELSE '' END
        WHEN 'credit_card' THEN CASE WHEN grace_days IS NULL THEN 'grace_days' ELSE '' END WHEN 'cash_loan' THEN CASE WHEN rate IS NULL THEN 'rate' ELSE '' END
        WHEN 'broker' THEN '' ELSE concat_ws(',', CASE WHEN rate IS NULL THEN 'rate' END, CASE WHEN down_payment_min_pct IS NULL THEN 'down_payment_min_pct' END) END AS missing,
        CASE WHEN product IN ('car_loan', 'mortgage') THEN amount * (1 - down_payment_pct / 100) ELSE amount END AS principal, rate / 1200 AS r FROM specs),
      s AS (SELECT *, CASE WHEN product = 'broker' THEN 'unknown_product' WHEN missing <> '' THEN 'no_data' WHEN product IN ('cash_loan', 'mortgage') AND principal > amount_max THEN 'not_offered'
        WHEN product IN ('car_loan', 'mortgage') AND down_payment_pct < down_payment_min_pct THEN 'not_offered' ELSE 'ok' END AS status,
        CASE WHEN r = 0 THEN principal / months ELSE principal * r / (1 - pow(1 + r, -months)) END AS pay, least(welcome_months, months) AS wm FROM m)
      SELECT p_partkey, product, missing, status, CASE WHEN status = 'ok' THEN round(1e-7 + CASE product WHEN 'deposit' THEN CASE WHEN capitalisation THEN amount * (pow(1 + r, months) - 1) ELSE amount * r * months END
          WHEN 'savings_account' THEN amount * coalesce(welcome_rate, 0) / 1200 * wm + amount * base_rate / 1200 * (months - wm) END, 2) END AS income,
        CASE WHEN status = 'ok' THEN round(1e-7 + CASE product WHEN 'debit_card' THEN 12 * least(spend * cashback_pct / 100, cashback_limit) + amount * balance_rate / 100 - 12 * monthly_fee
          WHEN 'credit_card' THEN 12 * monthly_fee + greatest(amount * cash_fee_pct / 100, cash_fee_min) END, 2) END AS year_value,
        CASE WHEN status = 'ok' AND product IN ('cash_loan', 'car_loan', 'mortgage') THEN round(pay + 1e-7, 2) END AS payment, CASE WHEN status = 'ok' AND product IN ('cash_loan', 'car_loan', 'mortgage') THEN round(pay * months - principal + 1e-7, 2) END AS overpayment FROM s""",
)
def scenario_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenarios.compute(spark.sql(f"WITH {_SPECS} SELECT * FROM specs", part=table(spark, sf_dir, "part")))
    return rows.select("p_partkey", "product", F.array_join("missing", ",").alias("missing"), "status", "income", "year_value", "payment", "overpayment")


@query(
    "catalogue_order",
    """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(nullif(list_position(['STANDARD', 'ECONOMY', 'SMALL'], p_type), 0), 99), lower(p_name), p_partkey) AS place FROM part""",
)
def catalogue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.in_catalogue_order(table(spark, sf_dir, "part"), ("STANDARD", "ECONOMY", "SMALL"), "p_brand", "p_type", "p_name", "p_partkey").select("p_partkey", F.col("place").cast("long").alias("place"))


@query(
    "program_choice_order",
    """WITH c AS (SELECT l_suppkey AS bank, p_type AS kind, p_brand AS program, count(DISTINCT l_orderkey) AS offers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)
    SELECT bank, program, kind, offers, row_number() OVER (PARTITION BY bank ORDER BY -least(offers, 2), coalesce(list_position(['Brand#5', 'Brand#2'], program), 99), kind, program) AS place FROM c""",
)
def program_choice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("kind"), F.col("p_brand").alias("program"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.col("l_suppkey").alias("bank")).join(part, "l_partkey")
    counts = lines.groupBy("bank", "kind", "program").agg(F.countDistinct("l_orderkey").alias("offers"))
    return market.in_choice_order(counts, ("Brand#5", "Brand#2"), "bank").withColumn("place", F.col("place").cast("long"))


@query("product_history", "SELECT l_partkey, o_orderdate, min(l_discount) AS rate_min, max(l_discount) AS rate_max FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def product_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that ended well, joined to the products they read: each product's rates run by run."""
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    products = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    return products.join(runs, "l_orderkey").groupBy("l_partkey", "o_orderdate").agg(F.min("l_discount").alias("rate_min"), F.max("l_discount").alias("rate_max"))


@query("documents_of_products", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def documents_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that products name, with their source and its bank."""
    named = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    sources = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(named, "o_orderkey", "left_semi").join(sources, "o_custkey").select("o_orderkey", "c_name", "n_name")


@query("not_in_region", "SELECT p_brand, count(*) AS products, count_if(r.s IS NOT NULL) AS absent FROM part LEFT JOIN (VALUES ('Brand#1', 3), ('Brand#1', 4), ('Brand#2', 5)) r(b, s) ON p_brand = b AND p_size = s GROUP BY 1")
def not_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that the configuration lists, by bank and path, as not offered in the region."""
    listed = spark.sql("SELECT * FROM VALUES ('Brand#1', 3), ('Brand#1', 4), ('Brand#2', 5) AS t(p_brand, p_size)").withColumn("absent", F.lit(True))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size").join(F.broadcast(listed), ["p_brand", "p_size"], "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("products"), F.count_if("absent").alias("absent"))


@query("banks_of_two_runs", "SELECT DISTINCT l_suppkey AS bank FROM lineitem WHERE l_shipdate::DATE IN (SELECT min(l_shipdate)::DATE FROM lineitem UNION ALL SELECT max(l_shipdate)::DATE FROM lineitem)")
def banks_of_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("bank"), F.to_date("l_shipdate").alias("run"))
    runs = lines.agg(F.min("run").alias("a"), F.max("run").alias("b")).select(F.explode(F.array("a", "b")).alias("run"))
    return lines.join(F.broadcast(runs), "run", "left_semi").select("bank").distinct()


_SCENARIO_RESULTS = "SELECT o_orderkey AS product, o_custkey % 7 AS scenario, floor(o_totalprice) AS income_max, CASE WHEN o_orderkey % 3 = 0 THEN 'term' END AS reason FROM orders"


@query("eligible_order", f"SELECT product, scenario, income_max::DOUBLE AS income_max, row_number() OVER (PARTITION BY scenario ORDER BY income_max DESC, product) AS place FROM ({_SCENARIO_RESULTS}) WHERE reason IS NULL")
def eligible_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SCENARIO_RESULTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return reports.eligible_in_order(rows, "product").select("product", "scenario", F.col("income_max").cast("double").alias("income_max"), F.col("place").cast("long").alias("place"))


@query(
    "chart_top_rows",
    f"""WITH r AS (SELECT *, product % 4 = 1 AS restricted, row_number() OVER (PARTITION BY scenario ORDER BY income_max DESC, product % 4 = 1, product) AS place FROM ({_SCENARIO_RESULTS}) WHERE reason IS NULL)
    SELECT product, scenario, restricted, place FROM r WHERE place <= 8""",
)
def chart_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SCENARIO_RESULTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return reports.chart_rows(rows, "product", F.col("product") % 4 == 1).select("product", "scenario", "restricted", F.col("place").cast("long").alias("place"))


@query(
    "recent_changes_newest",
    """WITH last AS (SELECT max(o_orderdate)::TIMESTAMP AS now FROM orders) SELECT o_orderkey FROM orders, last WHERE o_orderdate::TIMESTAMP >= now - INTERVAL 30 DAYS ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
)
def recent_changes_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    dated = orders.join(F.broadcast(orders.agg(F.max("at").alias("now"))), F.col("at") <= F.col("now"))  # one row
    return reports.recent_changes(dated, "at", "o_orderkey", F.col("now")).select("o_orderkey")


@query(
    "lights_order",
    """WITH l AS (SELECT p_partkey, p_type AS label, ['red', 'yellow', 'green', 'grey'][p_size % 4 + 1] AS light FROM part)
    SELECT p_partkey, light, row_number() OVER (ORDER BY list_position(['red', 'yellow', 'green', 'grey'], light), label, p_partkey) AS place FROM l""",
)
def lights_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("label"), F.element_at(F.array(*map(F.lit, reports.LIGHTS)), (F.col("p_size") % 4).cast("int") + 1).alias("light"))
    return reports.lights_in_order(rows, "label", "p_partkey").select("p_partkey", "light", F.col("place").cast("long").alias("place"))


_COPIES = {"example.com": "^/(de|en)/[0-9]*[05]$", "example.org": "^/fr/"}


@query(
    "sources_without_copies",
    """WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE page_id % 4 < 2 AND page_id % 5 > 0),
    h AS (SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), '^.*\\.(example\\.[a-z]+)$', '\\1') AS site FROM p)
    SELECT page_id FROM h WHERE NOT coalesce((regexp_replace(host, '^www\\.', '') = 'example.com' AND regexp_matches(path, '^/(de|en)/[0-9]*[05]$')) OR (regexp_replace(host, '^www\\.', '') = 'example.org' AND regexp_matches(path, '^/fr/')), FALSE)""",
)
def sources_without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources of two modes and three states: confirmed ones to fetch, without copies for search engines."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k % 4 < 2, "active").when(k % 4 == 2, "todo").otherwise("off").alias("status"), F.when(k % 5 > 0, "fetch").otherwise("manual").alias("mode"))
    return reports.eligible_sources(rows).where(~reports.is_listing_copy(F.col("url"), _COPIES)).select("page_id")
