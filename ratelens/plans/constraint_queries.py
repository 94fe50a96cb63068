"""A registry of banks and sources, and a dataset of products, held against their declared constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import constraints
from ratelens.plans.registry import query
from ratelens.sources.tables import table


@query(
    "registry_violations",
    """WITH b AS (SELECT s_suppkey AS id, 'bank-' || CASE WHEN s_suppkey % 40 = 7 THEN s_suppkey - 1 ELSE s_suppkey END AS slug, s_suppkey % 60 = 5 AS is_benchmark FROM supplier),
    s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 3 THEN 'nobody' ELSE 'bank-' || (p_partkey // 2 % 10 * 2) END AS bank, 'k' || p_partkey // 40 AS key, p_partkey % 31 = 4 AS odd, p_partkey % 37 = 5 AS foreign_host FROM part)
    SELECT 'repeated_slug' AS "constraint", id::BIGINT AS id FROM b WHERE slug IN (SELECT slug FROM b GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'two_benchmarks', id FROM b WHERE is_benchmark AND (SELECT count(*) FROM b WHERE is_benchmark) > 1
    UNION ALL SELECT 'unknown_bank', id FROM s WHERE bank NOT IN (SELECT slug FROM b)
    UNION ALL SELECT 'repeated_source', id FROM s WHERE (bank, key) IN (SELECT bank, key FROM s GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'mode', id FROM s WHERE odd UNION ALL SELECT 'foreign_host', id FROM s WHERE foreign_host AND bank <> 'nobody'""",
)
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    banks = table(spark, sf_dir, "supplier").select(s.alias("id"), F.concat(F.lit("bank-"), F.when(s % 40 == 7, s - 1).otherwise(s).cast("string")).alias("slug"), (s % 60 == 5).alias("is_benchmark"))
    number = (F.floor(p / 2) % 10 * 2).cast("string")
    bank = F.when(p % 29 == 3, "nobody").otherwise(F.concat(F.lit("bank-"), number))
    host = F.when(p % 37 == 5, F.concat(F.lit("bank"), number, F.lit(".ru.evil.com"))).otherwise(F.concat(F.element_at(F.array(F.lit(""), F.lit("www."), F.lit("online.")), (p % 3).cast("int") + 1), F.lit("bank"), number, F.lit(".ru")))
    sources = table(spark, sf_dir, "part").select(
        p.alias("id"),
        bank.alias("bank"),
        F.concat(F.lit("k"), F.floor(p / 40).cast("string")).alias("key"),
        F.concat(F.lit("https://"), host, F.lit("/page?x=1")).alias("url"),
        F.when(p % 31 == 4, F.when(p % 2 == 0, "other")).otherwise(F.when(p % 2 == 0, "fetch").otherwise("manual")).alias("mode"),
        F.when(p % 29 != 3, F.array(F.concat(F.lit("bank"), number, F.lit(".ru")), F.lit("bank-group.ru"))).alias("hosts"),
    )
    of_banks = constraints.violations(banks, "id", [constraints.Unique("repeated_slug", ["slug"]), constraints.AtMostOne("two_benchmarks", F.col("is_benchmark"))])
    return of_banks.union(constraints.violations(sources, "id", constraints.source_constraints(banks)))


@query(
    "dataset_violations",
    """SELECT unnest(list_filter([CASE WHEN p_partkey % 17 = 1 OR p_partkey % 19 = 2 THEN 'no_document' END, CASE WHEN p_partkey % 23 = 3 THEN 'no_check_date' END, CASE WHEN p_partkey % 29 = 4 THEN 'synthetic' END,
      CASE WHEN p_size > 45 THEN 'rate_max' END, CASE WHEN p_partkey % 31 = 5 THEN 'rate_min' END], lambda x: x IS NOT NULL)) AS "constraint", p_partkey::BIGINT AS id FROM part""",
)
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    documents = table(spark, sf_dir, "part").where(p % 19 != 2).select(p.alias("document"))
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"),
        F.when(p % 17 == 1, F.array().cast("array<bigint>")).otherwise(F.array(p)).alias("documents"),
        F.when(p % 23 != 3, F.lit("2026-01-01").cast("date")).alias("checked_at"),
        F.when(p % 29 == 4, "Вклад ТЕСТ").otherwise(F.col("p_name")).alias("name"),
        F.lit("https://bank.ru/vklad").alias("url"),
        F.when(p % 31 == 5, -0.5).when(p % 2 == 0, F.col("p_size").cast("double")).alias("rate_min"),
        F.when(F.col("p_size") > 45, 100.5).otherwise(F.col("p_size").cast("double")).alias("rate_max"),
    )
    return constraints.violations(constraints.with_known(rows, documents, "id"), "id", constraints.dataset_constraints())
