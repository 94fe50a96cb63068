"""Market, quality and coverage queries. bank = supplier, program = part type, rate from discount and tax."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.functions.finance import to_cents
from ratelens.operators import market, quality
from ratelens.plans.registry import query
from ratelens.sources.tables import table

HOME = 1


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """program, bank, category, rate and the keys of each offer line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size")
    rate = F.round(F.col("l_discount") * 100 + F.col("l_tax") * 10, 3)
    return line.join(part, "l_partkey").withColumns({"program": F.col("p_type"), "bank": F.col("l_suppkey"), "category": F.col("p_brand"), "rate": rate})


OFFERS = "offers AS (SELECT p_type AS program, l_suppkey AS bank, p_brand AS category, p_size, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate, l_extendedprice, l_quantity, round(l_discount * 100 + l_tax * 10, 3) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey)"
BEST = OFFERS + ", best AS (SELECT program, bank, max(rate) AS value FROM offers GROUP BY 1, 2)"
POSITION = BEST + """, marked AS (SELECT *, max(CASE WHEN bank = 1 THEN value END) OVER (PARTITION BY program) AS home_value FROM best),
pos0 AS (
  SELECT program, max(home_value) AS home_value, max(value) AS best_value, round(median(value) FILTER (WHERE bank <> 1), 3) AS others_median,
         count(*) AS banks_compared, count(*) FILTER (WHERE bank <> 1) AS others,
         CASE WHEN max(home_value) IS NOT NULL THEN 1 + count(*) FILTER (WHERE value > home_value) END AS rank
  FROM marked GROUP BY program
), pos1 AS (SELECT *, round(home_value - best_value, 3) AS delta_best, round(home_value - others_median, 3) AS advantage FROM pos0),
positions AS (
  SELECT program, home_value, best_value, others_median, banks_compared, rank, delta_best, advantage,
         CASE WHEN home_value IS NULL THEN CASE WHEN others > 0 THEN 'not_found' ELSE 'no_data' END WHEN others = 0 THEN 'no_rivals'
              WHEN rank = 1 THEN 'leader' WHEN advantage >= -0.5 THEN 'in_market' ELSE 'behind' END AS status
  FROM pos1)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.best_by_bank(offers(spark, sf_dir).select("program", "bank", "rate"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_position(best(spark, sf_dir), F.lit(HOME))


@query("market_position", f"WITH {POSITION} SELECT * FROM positions")
def market_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.in_report_order(positions(spark, sf_dir))


@query(
    "best_offer_per_bank",
    f"""WITH {OFFERS} SELECT program, bank, count(*) AS offers, arg_min(l_orderkey, (-rate, l_orderkey, l_linenumber)) AS l_orderkey,
    arg_min(l_linenumber, (-rate, l_orderkey, l_linenumber)) AS l_linenumber, max(rate) AS value FROM offers GROUP BY 1, 2""",
)
def best_offer_per_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.best_offer_rows(offers(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@query(
    "leader_runner_up_gap",
    f"""WITH {BEST}, r AS (SELECT *, row_number() OVER w AS n, lead(value) OVER w AS runner_up_value FROM best WINDOW w AS (PARTITION BY program ORDER BY value DESC, bank))
    SELECT program, bank AS leader, value AS leader_value, runner_up_value, round(abs(value - runner_up_value), 3) AS gap FROM r WHERE n = 1""",
)
def leader_runner_up_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.leader_gap(best(spark, sf_dir))


LIGHTS = BEST + """, mine AS (SELECT program, value AS home_value FROM best WHERE bank = 1), pairs AS (
  SELECT b.program, b.bank, m.home_value, b.value AS rival_value, round(m.home_value - b.value, 3) AS delta FROM best b LEFT JOIN mine m USING (program) WHERE b.bank <> 1),
lights AS (SELECT *, CASE WHEN delta IS NULL THEN 'grey' WHEN abs(delta) < 0.5 THEN 'yellow' WHEN delta > 0 THEN 'green' WHEN abs(delta) >= 1.0 THEN 'red' ELSE 'yellow' END AS light FROM pairs)"""


@query("traffic_light", f"WITH {LIGHTS} SELECT * FROM lights")
def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.traffic_light(best(spark, sf_dir), F.lit(HOME))


@query("traffic_light_counts", f"WITH {LIGHTS} SELECT l.light, count(x.light) AS n FROM (VALUES ('red'), ('yellow'), ('green'), ('grey')) l(light) LEFT JOIN lights x ON x.light = l.light GROUP BY 1")
def traffic_light_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.dense_counts(traffic_light(spark, sf_dir), "light", ("red", "yellow", "green", "grey"))


@query(
    "heatmap_bucket",
    f"""WITH {BEST}, h AS (SELECT *, round(value - median(value) OVER (PARTITION BY program), 3) AS advantage FROM best)
    SELECT program, bank, value, advantage, CASE WHEN abs(advantage) >= 0.25 THEN (least(3, floor(abs(advantage) / 0.5 + 0.5)) * sign(advantage))::INT ELSE 0 END AS level FROM h""",
)
def heatmap_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.heatmap(best(spark, sf_dir))


@query(
    "bank_positioning",
    f"""WITH {BEST}, banks AS (
      SELECT bank, round(avg(value) FILTER (WHERE starts_with(program, 'S')), 3) AS savings_mean, round(avg(value) FILTER (WHERE NOT starts_with(program, 'S')), 3) AS loan_mean, count(*) AS programs FROM best GROUP BY bank)
    SELECT *, round((SELECT median(savings_mean) FROM banks), 3) AS savings_axis, round((SELECT median(loan_mean) FROM banks), 3) AS loan_axis FROM banks""",
)
def bank_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.positioning(best(spark, sf_dir), F.col("program").startswith("S"))


@query(
    "status_share_by_block",
    f"""WITH {POSITION}, b AS (SELECT split_part(program, ' ', 1) AS block, status, count(*) AS n FROM positions GROUP BY 1, 2)
    SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY block), 1)::DOUBLE AS share_pct FROM b""",
)
def status_share_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.status_share(positions(spark, sf_dir).withColumn("block", F.substring_index("program", " ", 1)))


@query(
    "market_insights",
    f"""WITH {POSITION} SELECT min(advantage) AS worst_gap, arg_min(program, (advantage, program)) AS worst_program, max(advantage) AS best_gap,
    count(*) FILTER (WHERE status = 'leader') AS leaders, count(*) FILTER (WHERE status = 'behind') AS behind FROM positions WHERE advantage IS NOT NULL""",
)
def market_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).where("advantage is not null")
    return rows.agg(F.min("advantage").alias("worst_gap"), F.min_by("program", F.struct("advantage", "program")).alias("worst_program"), F.max("advantage").alias("best_gap"), F.count_if(F.col("status") == "leader").alias("leaders"), F.count_if(F.col("status") == "behind").alias("behind"))


ASSESSED = OFFERS + """, assessed AS (
  SELECT *, l_returnflag <> 'R' AS rated, rate AS value, list_filter([CASE WHEN l_returnflag = 'N' AND p_size < 5 THEN 'region_not_confirmed' END,
    CASE WHEN rate <= 0 OR rate >= 100 THEN 'rate_out_of_range' END, CASE WHEN starts_with(program, 'S') AND rate > 10.0 THEN 'savings_over_key' END,
    CASE WHEN NOT starts_with(program, 'S') AND rate < 7.0 THEN 'credit_under_key' END, CASE WHEN p_size > 45 THEN 'from_showcase' END], lambda x: x IS NOT NULL) AS issues FROM offers),
judged AS (SELECT *, CASE WHEN len(list_filter(issues, lambda x: x <> 'from_showcase')) > 0 THEN 'low' WHEN len(issues) > 0 THEN 'medium' ELSE 'high' END AS confidence FROM assessed)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).withColumn("value", F.col("rate")).withColumn("rated", F.col("l_returnflag") != "R")
    rules = quality.rate_rules(F.col("value"), F.lit(7.0), F.col("program").startswith("S"), ~((F.col("l_returnflag") == "N") & (F.col("p_size") < 5)))
    return quality.assess(rows, [*rules, ("from_showcase", "medium", F.col("p_size") > 45)])


@query(
    "quality_rollup",
    f"""WITH {ASSESSED}, counts AS (
      SELECT bank, category, count(*) AS products, count(*) FILTER (WHERE rated) AS rated, count(*) FILTER (WHERE rated AND value IS NOT NULL) AS with_rate,
             count(*) FILTER (WHERE rated AND value IS NOT NULL AND confidence <> 'low') AS usable, count(*) FILTER (WHERE confidence = 'low') AS low FROM judged GROUP BY 1, 2),
    kinds AS (SELECT bank, category, issue, count(*) AS n FROM (SELECT bank, category, unnest(issues) AS issue FROM judged) GROUP BY 1, 2, 3),
    maps AS (SELECT bank, category, string_agg(issue || '=' || n, ';' ORDER BY issue || '=' || n) AS issue_counts FROM kinds GROUP BY 1, 2)
    SELECT c.*, coalesce(issue_counts, '') AS issue_counts, CASE WHEN rated > 0 THEN round(100.0 * usable / rated, 1) END::DOUBLE AS coverage_pct FROM counts c LEFT JOIN maps USING (bank, category)""",
)
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(assessed(spark, sf_dir), "bank", "category")


@query("manual_review_list", f"WITH {ASSESSED} SELECT l_orderkey, l_linenumber, program, bank, value, array_to_string(list_sort(issues), ',') AS issues FROM judged WHERE rated AND confidence = 'low' AND NOT list_contains(issues, 'region_not_confirmed')")
def manual_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir).where(F.col("rated") & (F.col("confidence") == "low") & ~F.array_contains("issues", "region_not_confirmed"))
    return rows.select("l_orderkey", "l_linenumber", "program", "bank", "value", F.array_join(F.array_sort("issues"), ",").alias("issues"))


@query(
    "data_funnel",
    f"""WITH {ASSESSED}, f AS (SELECT count(*) FILTER (WHERE rated) AS a, count(*) FILTER (WHERE rated AND value IS NOT NULL) AS b,
      count(*) FILTER (WHERE rated AND value IS NOT NULL AND confidence <> 'low') AS c, count(*) FILTER (WHERE rated AND value IS NOT NULL AND confidence <> 'low' AND bank = 1) AS d FROM judged)
    SELECT 1 AS position, 'rated' AS step, a AS n FROM f UNION ALL SELECT 2, 'found', b FROM f UNION ALL SELECT 3, 'usable', c FROM f UNION ALL SELECT 4, 'ranked', d FROM f""",
)
def data_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.funnel(assessed(spark, sf_dir), [("rated", F.col("rated")), ("found", F.col("value").isNotNull()), ("usable", F.col("confidence") != "low"), ("ranked", F.col("bank") == HOME)])


@query(
    "coverage_matrix_dense",
    f"""WITH {OFFERS}, cells AS (SELECT * FROM (SELECT DISTINCT p_brand AS category FROM part) CROSS JOIN (SELECT s_suppkey AS bank FROM supplier)),
    found AS (SELECT category, bank, count(*) AS products, count(*) FILTER (WHERE l_returnflag = 'R' AND rate > 8) AS rated FROM offers WHERE p_size < 10 GROUP BY 1, 2),
    links AS (SELECT category, bank, arg_min('/' || l_partkey, (length('/' || l_partkey), '/' || l_partkey)) AS url FROM offers GROUP BY 1, 2)
    SELECT category, bank, coalesce(products, 0) AS products, coalesce(rated, 0) AS rated, url,
           CASE WHEN rated > 0 THEN 'compared' WHEN products > 0 THEN 'collected' WHEN url IS NOT NULL THEN 'link' ELSE 'none' END AS status
    FROM cells LEFT JOIN found USING (category, bank) LEFT JOIN links USING (category, bank)""",
)
def coverage_matrix_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir)
    products = rows.where("p_size < 10").select("category", "bank", ((F.col("l_returnflag") == "R") & (F.col("rate") > 8)).alias("rated"))
    links = rows.select("category", "bank", F.concat(F.lit("/"), F.col("l_partkey").cast("string")).alias("url"))
    categories = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category")).distinct()
    return quality.coverage_matrix(products, links, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bank")), categories)


@query(
    "sample_per_cell",
    f"""WITH {OFFERS}, r AS (SELECT bank, category, l_orderkey, l_linenumber, rate, row_number() OVER (PARTITION BY bank, category ORDER BY l_returnflag, rate DESC, l_orderkey, l_linenumber) AS place FROM offers)
    SELECT * FROM r WHERE place <= 2""",
)
def sample_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = quality.sample_cells(offers(spark, sf_dir), ["bank", "category"], [F.col("l_returnflag"), F.desc("rate"), F.col("l_orderkey"), F.col("l_linenumber")], 2)
    return picked.select("bank", "category", "l_orderkey", "l_linenumber", "rate", F.col("place").cast("long").alias("place"))


@query(
    "audit_scores",
    f"""WITH {OFFERS}, cells AS (
      SELECT bank, 'rate' AS criterion, CASE WHEN rate > 8 THEN 1.0 WHEN rate > 4 THEN 0.6 ELSE 0.3 END AS points, l_returnflag <> 'R' AS reachable FROM offers
      UNION ALL SELECT bank, 'size', CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END, true FROM offers
      UNION ALL SELECT bank, 'volume', CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.5 END, p_size > 10 FROM offers),
    m AS (SELECT bank, criterion, avg(points) FILTER (WHERE reachable) AS mean, avg(CASE WHEN reachable THEN 0.0 ELSE 1.0 END) AS lost FROM cells GROUP BY 1, 2),
    s AS (SELECT bank, CASE WHEN lost > 0.3 THEN least(10 * mean, 7.0) ELSE 10 * mean END AS score, CASE criterion WHEN 'rate' THEN 0.5 WHEN 'size' THEN 0.3 ELSE 0.2 END AS weight FROM m)
    SELECT bank, round(sum(score * weight)::DOUBLE / sum(weight)::DOUBLE, 2) AS total, count(*) AS criteria FROM s WHERE score IS NOT NULL GROUP BY bank""",
)
def audit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select(
        "bank",
        F.explode(
            F.array(
                F.struct(F.lit("rate").alias("criterion"), F.when(F.col("rate") > 8, 1.0).when(F.col("rate") > 4, 0.6).otherwise(0.3).alias("points"), (F.col("l_returnflag") != "R").alias("reachable")),
                F.struct(F.lit("size").alias("criterion"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("points"), F.lit(True).alias("reachable")),
                F.struct(F.lit("volume").alias("criterion"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.5).alias("points"), (F.col("p_size") > 10).alias("reachable")),
            )
        ).alias("c"),
    )
    return quality.audit_score(rows.select("bank", "c.*"), ["bank"], {"rate": 0.5, "size": 0.3, "volume": 0.2})


KINDS = [("premium", "^PROMO|^LARGE"), ("niche", "BURNISHED|ANODIZED"), ("short_term", "TIN$")]


@query(
    "special_rows",
    f"""WITH {OFFERS}, k AS (SELECT *, CASE WHEN regexp_matches(program, '^PROMO|^LARGE') THEN 'premium' WHEN regexp_matches(program, 'BURNISHED|ANODIZED') THEN 'niche' WHEN regexp_matches(program, 'TIN$') THEN 'short_term' ELSE 'base' END AS kind FROM offers)
    SELECT category, kind, bank, program, count(*) AS offers, max(rate) AS top_rate FROM k WHERE kind <> 'base' GROUP BY 1, 2, 3, 4""",
)
def special_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.functions.rules import first_match

    rows = offers(spark, sf_dir).withColumn("kind", first_match(F.col("program"), KINDS, "base")).where("kind <> 'base'")
    return rows.groupBy("category", "kind", "bank", "program").agg(F.count("*").alias("offers"), F.max("rate").alias("top_rate"))


@query(
    "calculator_offers",
    f"""WITH {BEST}, sp AS (SELECT program, bank, list_sort(list_distinct(list(rate::VARCHAR))) AS rates FROM offers WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT b.program, b.bank, b.value, array_to_string(coalesce(sp.rates, [])[1:3], ',') AS specials FROM best b LEFT JOIN sp USING (program, bank)""",
)
def calculator_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir)
    distinct = rows.where("l_returnflag = 'A'").select("program", "bank", F.col("rate").cast("string").alias("r")).distinct()
    specials = distinct.groupBy("program", "bank").agg(F.array_join(F.slice(F.array_sort(F.collect_list("r")), 1, 3), ",").alias("specials"))
    return best(spark, sf_dir).join(specials, ["program", "bank"], "left").withColumn("specials", F.coalesce("specials", F.lit("")))


@query(
    "common_program_semi",
    f"""WITH {BEST}, a AS (SELECT * FROM best WHERE bank = 1), b AS (SELECT * FROM best WHERE bank = 2), c AS (SELECT program FROM a INTERSECT SELECT program FROM b)
    SELECT * FROM a WHERE program IN (SELECT program FROM c) UNION ALL SELECT * FROM b WHERE program IN (SELECT program FROM c)""",
)
def common_program_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = best(spark, sf_dir)
    return market.common_programs(rows.where("bank = 1"), rows.where("bank = 2"))


@query(
    "segment_verdict",
    f"""WITH {OFFERS}, v AS (SELECT category AS segment, bank, l_returnflag AS kind, max(rate) AS value FROM offers WHERE bank IN (1, 2) GROUP BY 1, 2, 3),
    prio(kind, priority) AS (VALUES ('R', 1), ('A', 2), ('N', 3)),
    j AS (SELECT h.segment, h.kind, h.value AS home_value, r.value AS rival_value, row_number() OVER (PARTITION BY h.segment ORDER BY priority) AS n FROM v h JOIN v r ON h.segment = r.segment AND h.kind = r.kind AND h.bank = 1 AND r.bank = 2 JOIN prio p ON p.kind = h.kind)
    SELECT s.segment, j.kind, home_value, rival_value, CASE WHEN home_value IS NULL THEN 'grey' WHEN home_value = rival_value THEN 'yellow' WHEN home_value > rival_value THEN 'green' ELSE 'red' END AS verdict
    FROM (SELECT DISTINCT segment FROM v) s LEFT JOIN (SELECT * FROM j WHERE n = 1) j USING (segment)""",
)
def segment_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select(F.col("category").alias("segment"), "bank", F.col("l_returnflag").alias("kind"), "rate")
    by = lambda b: rows.where(F.col("bank") == b).groupBy("segment", "kind").agg(F.max("rate").alias("value"))
    order = spark.sql("SELECT * FROM VALUES ('R', 1), ('A', 2), ('N', 3) AS t(kind, priority)")
    return market.segment_verdict(by(1), by(2), order)


@query(
    "analogue_best_match",
    f"""WITH {OFFERS}, tags AS (SELECT category, bank, l_partkey, max(rate) AS rate, list_sort(list_distinct(string_split(max(program), ' '))) AS tags FROM offers GROUP BY 1, 2, 3),
    scored AS (
      SELECT h.l_partkey AS home_part, r.bank, r.l_partkey AS rival_part, r.rate,
             CASE WHEN list_contains(h.tags, 'PROMO') <> list_contains(r.tags, 'PROMO') THEN -10 ELSE
             1 + 3 * len(list_intersect(h.tags, r.tags)) - 2 * len(list_filter(r.tags, lambda x: NOT list_contains(h.tags, x))) - len(list_filter(h.tags, lambda x: NOT list_contains(r.tags, x))) END AS score
      FROM tags h JOIN tags r USING (category) WHERE h.bank = 1 AND r.bank <> 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY home_part, bank ORDER BY score DESC, rate DESC, rival_part DESC) AS n FROM scored WHERE score >= 1)
    SELECT home_part, bank, rival_part, rate, score, score >= 2 AS close FROM top WHERE n = 1""",
)
def analogue_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.operators.matching import best_analogue

    rows = offers(spark, sf_dir).groupBy("category", "bank", "l_partkey").agg(F.max("rate").alias("rate"), F.max("program").alias("program"))
    rows = rows.withColumn("tags", F.array_distinct(F.split("program", " ")))
    found = best_analogue(rows, F.lit(HOME), "category", "l_partkey", strict=("PROMO",))
    return found.select(F.col("home_product").alias("home_part"), "bank", F.col("rival_product").alias("rival_part"), "rate", F.col("score").cast("long").alias("score"), (F.col("score") >= 2).alias("close"))


@query("history_mean_series", f"WITH {OFFERS} SELECT bank, strftime(l_shipdate, '%Y-%m-01') AS run_month, round(avg(rate) + 1e-7, 2) AS mean_rate, count(*) AS offers FROM offers GROUP BY 1, 2")
def history_mean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir)
    return rows.groupBy("bank", F.date_format("l_shipdate", "yyyy-MM-01").alias("run_month")).agg(to_cents(F.avg("rate")).alias("mean_rate"), F.count("*").alias("offers"))


@query(
    "source_health_left_join",
    "SELECT s_suppkey AS bank, n_name AS region, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ok, count(l_orderkey) AS runs FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY 1, 2",
)
def source_health_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_ok"), F.count("*").alias("runs"))
    banks = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return banks.join(runs, "s_suppkey", "left").select(F.col("s_suppkey").alias("bank"), F.col("n_name").alias("region"), "last_ok", F.coalesce("runs", F.lit(0)).alias("runs"))


@query("banks_without_data_anti", "SELECT s_suppkey AS bank, s_name AS name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.08 AND l_tax < 0.01 AND l_quantity < 5)")
def banks_without_data_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    having = table(spark, sf_dir, "lineitem").where("l_discount > 0.08 and l_tax < 0.01 and l_quantity < 5").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, sf_dir, "supplier").join(having, "s_suppkey", "left_anti").select(F.col("s_suppkey").alias("bank"), F.col("s_name").alias("name"))


@query(
    "bi_conditions_long",
    """SELECT p_partkey AS product_id, parameter, value FROM (SELECT p_partkey, p_size::VARCHAR AS size, p_brand AS brand, p_type AS kind, printf('%.2f', p_retailprice) AS price FROM part) UNPIVOT (value FOR parameter IN (size, brand, kind, price))""",
)
def bi_conditions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.sources.sinks import long_format

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.format_string("%.2f", "p_retailprice").alias("price"))
    return long_format(part, ["product_id"], ["size", "brand", "kind", "price"])


@query(
    "product_slug_ids",
    """WITH s AS (SELECT p_partkey, p_brand, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS slug FROM part)
    SELECT p_partkey AS product_id, slug || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS slug_id FROM s WINDOW w AS (PARTITION BY p_brand, slug ORDER BY p_partkey)""",
)
def product_slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.functions.text import slug

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", slug(F.col("p_name")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("p_brand", "slug").orderBy("p_partkey"))
    return rows.withColumn("n", n).select(F.col("p_partkey").alias("product_id"), F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise("")).alias("slug_id"))
