"""Text, page and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.functions import text
from ratelens.operators import matching
from ratelens.operators.pages import once
from ratelens.plans.registry import query
from ratelens.sources import html
from ratelens.sources.tables import cut, table

_SQUEEZED = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("text_normalise_dedup_exact", f"WITH n AS (SELECT doc_id, md5({_SQUEEZED}) AS h FROM documents) SELECT h AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM n GROUP BY 1")
def text_normalise_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " +", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("numbers_in_text", r"SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[0-9]+')).list_sort(), ',') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))))
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.array_join(found, ",").alias("numbers"))


@query("latest_doc_semi", "SELECT source, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents GROUP BY source, lang)")
def latest_doc_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    newest = docs.groupBy("source", "lang").agg(F.max("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(newest, "doc_id", "left_semi").select("source", "doc_id", "n_chars")


@query("content_store_distinct", "SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1, 2")
def content_store_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(
    "lines_with_digits_window",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    w AS (SELECT *, max(CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l)
    SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM w WHERE near = 1 GROUP BY 1""",
)
def lines_with_digits_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each text's own array of lines, so nothing is exploded or shuffled."""
    lines = F.split("text", "\n")
    digits = F.transform("lines", lambda x: x.rlike("[0-9]"))
    near = F.filter("lines", lambda x, i: F.coalesce(F.get("digits", i - 1), F.lit(False)) | F.get("digits", i) | F.coalesce(F.get("digits", i + 1), F.lit(False)))
    # Each array is made once: a filter that was pushed below them would make all digits of a text anew for each of its lines.
    rows = once(table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")), digits=digits)
    rows = once(rows, near=near).select("doc_id", "near")
    chars = F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.where("size(near) > 0").select("doc_id", F.size("near").cast("long").alias("lines"), chars.alias("chars"))


@query("url_strip_tracking", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])utm_[^=&#]*=[^&#]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&]+(#|$)', '\1', 'g') AS url FROM pages")
def url_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_tracking(F.col("url")).alias("url"))


@query(
    "url_section_class",
    r"""SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(de|fr)/') THEN 'continental' ELSE 'other' END AS section,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) LIKE '%.example.org' AS official FROM pages""",
)
def url_section_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ratelens.functions.rules import first_match

    host = text.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), first_match(F.col("url"), [("english", "/en/"), ("continental", "/(de|fr)/")], "other").alias("section"), text.is_official(host, ["example.org"]).alias("official"))


@query("html_title_links", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("html_tree_links")
def html_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(table(spark, sf_dir, "pages"))


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).alias("chars"), F.sha2(plain, 256).alias("sha"))


_PLAIN = """trim(regexp_replace(regexp_replace(translate(lower(text), 'ё', 'е'), '[«»"''.,:;!?()]+', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query(
    "reference_check",
    f"""WITH d AS (SELECT doc_id, doc_id // 2 AS key, source = (SELECT min(source) FROM documents) AS listed, nullif({_PLAIN}, '') AS name FROM documents)
    SELECT doc_id, CASE WHEN key IN (SELECT key FROM d WHERE NOT listed) THEN 'key' WHEN name IN (SELECT name FROM d WHERE NOT listed AND name IS NOT NULL) THEN 'name' ELSE 'missing' END AS how FROM d WHERE listed""",
)
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source's documents as the list, all other sources' as what was collected: by pairs of ids, then by whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("key"), "source", "text")
    listed = docs.crossJoin(F.broadcast(docs.agg(F.min("source").alias("first")))).withColumn("listed", F.col("source") == F.col("first"))
    reference = listed.where("listed").select(F.col("key").alias("pair"), "text", "doc_id")
    found = matching.check_reference(reference, listed.where("not listed").select(F.col("key").alias("pair"), "text"), "pair", "text", keep=["doc_id"])
    return found.select("doc_id", "how")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title, normalised: the posts of the news operators. event: the page a feed link has led to. Pages are read once, titles often."""
    title = text.normalised(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    fed = F.col("url").contains("utm_source")
    return cut(table(spark, sf_dir, "pages").select("page_id", title.alias("title"), fed.alias("fed"), F.when(F.col("url").startswith("https"), F.col("page_id")).alias("event")), "titles")


@query("fuzzy_groups")
def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact titles first (one row each goes on), then fuzzy links between different titles, then greedy groups."""
    titles = _titles(spark, sf_dir)
    distinct = titles.groupBy("title").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))
    links = matching.fuzzy_links(distinct, "page_id", "title")
    groups = matching.group_by_earliest(distinct, links, "page_id")
    return distinct.join(groups, "page_id").select("page_id", "copies", "group_id")


@query("history_attach")
def history_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    old = titles.where("not fed").groupBy("title").agg(F.min("page_id").alias("page_id"), F.min("event").alias("event"))
    return matching.match_history(titles.where("fed").select("page_id", "title"), old, "page_id", "title", "event")


#: Promotion texts made from the parts table: a kind of phrase, an amount and a unit.
_OFFERS = """offers AS (
  SELECT p_partkey AS promo, concat(
    element_at_(p_partkey % 9, 'снизим ставку до', 'кешбэк', 'вернём', 'скидка', 'розыгрыш', 'обслуживание бесплатно', 'до', 'подарок', 'бонусных баллов'), ' ',
    CAST(1 + p_partkey % 97 AS STRING_), element_at_(p_partkey % 5, ' %', ' 000 ₽', '5 руб', ' баллов', ' раз')) AS said FROM part)"""


def _offers(spark_sql: bool) -> str:
    """The same text in either dialect: picking from a list is elt() in one and a list subscript in the other."""
    import re

    def pick(m: re.Match) -> str:
        number, options = m[1], m[2]
        return f"elt(CAST({number} AS INT) + 1, {options})" if spark_sql else f"list_extract([{options}], CAST({number} AS INT) + 1)"

    text_type = "STRING" if spark_sql else "VARCHAR"
    return re.sub(r"element_at_\((p_partkey % \d), ([^)]*)\)", pick, _OFFERS).replace("STRING_", text_type)


@query(
    "promo_benefit",
    f"""WITH {_offers(False)}, n AS (
      SELECT promo, said,
        TRY_CAST(replace(nullif(regexp_extract(said, '([0-9]{{1,3}}([.,][0-9]{{1,2}})?)\\s*%', 1), ''), ',', '.') AS DOUBLE) AS pct,
        TRY_CAST(replace(nullif(regexp_extract(said, '([0-9][0-9 ]*)(₽|руб)', 1), ''), ' ', '') AS DOUBLE) AS rub,
        TRY_CAST(replace(nullif(regexp_extract(said, '([0-9][0-9 ]*)([а-яё]+ +){{0,2}}балл', 1), ''), ' ', '') AS DOUBLE) AS pts FROM offers),
    k AS (SELECT *, CASE WHEN contains(said, 'ставк') THEN 'rate' WHEN regexp_matches(said, 'кешб[эе]к|верн[её]м') THEN 'cashback' WHEN contains(said, 'балл') THEN 'points'
      WHEN contains(said, 'розыгрыш') THEN 'prize' WHEN contains(said, 'скидк') THEN 'discount' WHEN regexp_matches(said, 'бесплатн|0 *₽') THEN 'free' WHEN rub IS NOT NULL THEN 'money' ELSE 'other' END AS kind FROM n)
    SELECT promo, kind, CASE kind WHEN 'rate' THEN pct WHEN 'cashback' THEN coalesce(pct, rub) WHEN 'discount' THEN coalesce(pct, rub) WHEN 'points' THEN pts WHEN 'prize' THEN rub WHEN 'money' THEN rub WHEN 'other' THEN pct END AS amount,
      CASE WHEN kind = 'rate' THEN '%' WHEN kind IN ('cashback', 'discount') THEN CASE WHEN pct IS NOT NULL THEN '%' ELSE 'rub' END WHEN kind = 'points' THEN 'pts' WHEN kind IN ('prize', 'money') THEN 'rub'
        WHEN kind = 'other' AND pct IS NOT NULL THEN '%' ELSE '' END AS unit FROM k""",
)
def promo_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _offers(True).replace("FROM part)", "FROM {part})")
    found = spark.sql(f"WITH {said} SELECT * FROM offers", part=table(spark, sf_dir, "part")).withColumn("b", text.benefit(F.col("said")))
    return found.select("promo", F.col("b.type").alias("kind"), F.col("b.value").alias("amount"), F.col("b.unit").alias("unit"))
