"""Tables, dumps, manifests and catalogues that people or crawlers leave: read, mapped and checked by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import text
from ratelens.operators.snapshots import latest_per_key
from ratelens.sources.tables import cut, drop


def mapped_table(rows: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """An uploaded table under the library's names; headers match a synonym exactly or by prefix, each header once.

    Columns that no synonym names go to a map `terms`.
    """
    free = {c: c.strip().lower() for c in rows.columns}
    chosen: dict[str, str] = {}
    for name, options in synonyms.items():
        for test in (lambda h, o: h == o, lambda h, o: h.startswith(o)):
            hit = next((c for o in options for c, h in free.items() if test(h, o.lower())), None)
            if hit is not None:
                chosen[name] = hit
                del free[hit]
                break
    known = [F.col(f"`{chosen[n]}`").alias(n) if n in chosen else F.lit(None).cast("string").alias(n) for n in synonyms]
    rest = [x for c in free for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    terms = F.map_filter(F.create_map(*rest), lambda _, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*known, terms.alias("terms"))


def read_delimited(spark: SparkSession, path: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """A csv or tsv with a header; the separator is the one of ; , and tab that its first line has most of."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    return mapped_table(spark.read.option("header", True).option("sep", max(";,\t", key=line.count)).csv(path), synonyms)


def read_dumps(spark: SparkSession, path: str, marker: str = "<TEXT>") -> DataFrame:
    """Saved page dumps, a file each: header lines "NAME: value" as a map, and the text after the marker."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    head = F.substring_index("value", marker, 1)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.rlike("^[^:]+:"))
    header = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]+:", "")))))
    body = F.when(F.contains("value", F.lit(marker)), F.trim(F.regexp_replace("value", rf"(?s)^.*?\Q{marker}\E", ""), F.lit(" \r\n")))
    return files.select("file", header.alias("header"), body.alias("text"))


def import_manifest(manifest: DataFrame, stored: DataFrame, allowed: list[str], most_bytes: int = 20_000_000) -> DataFrame:
    """What an import of a manifest would do with each file: rejected with a reason, unchanged, or imported.

    manifest: source, content, content_type; stored: source, sha256, fetched_at. The newest stored document counts.
    """
    newest = latest_per_key(stored, ["source"], [F.desc("fetched_at")]).select("source", F.col("sha256").alias("stored_sha"))
    rows = manifest.withColumn("sha256", F.sha2("content", 256)).join(newest, "source", "left")
    reason = F.when(F.col("source").isNull(), "no_source").when(~F.col("content_type").isin(*allowed), "content_type").when(F.length("content") > most_bytes, "too_large").when(F.length("content") == 0, "empty")
    status = F.when(reason.isNotNull(), "rejected").when(F.col("sha256") == F.col("stored_sha"), "unchanged").otherwise("imported")
    return rows.select("source", "sha256", status.alias("status"), reason.alias("reason"))


def ids_in_text(files: DataFrame, content: str, file: str, most: int = 50) -> DataFrame:
    """Tax ids of list files: file, position, id, valid, truncated. A lost leading zero is put back, a repeated id counts once in its file.

    Of each file only the first `most` valid ids are taken (the feature of such a list); truncated says that it has more.
    """
    found = F.regexp_extract_all(content, F.lit(r"(?<!\d)(\d{9,12})(?!\d)"), F.lit(1))
    whole = F.array_distinct(F.transform(found, lambda x: F.when(F.length(x).isin(9, 11), F.concat(F.lit("0"), x)).otherwise(x)))
    judged = F.transform(whole, lambda x, i: F.struct(i.alias("position"), x.alias("id"), text.tax_id_valid(x).alias("valid")))
    rows = files.select(F.col(file).alias("file"), judged.alias("ids")).withColumn("good", F.filter("ids", lambda x: x["valid"]))
    last = F.get("good", F.lit(most - 1))["position"]
    kept = F.filter("ids", lambda x: ~x["valid"] | F.col("last").isNull() | (x["position"] <= F.col("last")))
    rows = rows.withColumn("last", last).withColumn("truncated", F.size("good") > most)
    return rows.select("file", "truncated", F.explode(kept).alias("x")).select("file", "x.position", "x.id", "x.valid", "truncated")


def discovered_links(pages: DataFrame, url: str, html: str, official: list[str], keywords: list[tuple[str, str]]) -> DataFrame:
    """Product links of pages: absolute, without tracking, on official hosts, with the category of the first keyword; the first page that shows a link wins."""
    from ratelens.functions.rules import first_match

    base = F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1)
    links = pages.select(F.col(url).alias("page"), base.alias("base"), F.posexplode(F.regexp_extract_all(html, F.lit(r'<a\b[^>]*href="([^"#]+)'), F.lit(1))).alias("position", "href"))
    absolute = F.when(F.col("href").rlike("^[a-zA-Z][\\w+.-]*://"), F.col("href")).when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.concat("base", F.lit("/"), "href"))
    rows = links.withColumn("link", text.without_tracking(absolute))
    rows = rows.where(text.is_official(text.url_host(F.col("link")), official)).withColumn("category", first_match(F.lower("link"), keywords, None)).where("category is not null")
    return rows.groupBy("link", "category").agg(F.min(F.struct("page", "position")).alias("first")).select("link", "category", F.col("first.page").alias("page"))


def site_catalogue(nodes: DataFrame, sections: list[str], skip: str, promo: str) -> DataFrame:
    """Pages of a site tree under the wanted sections: path, title, section, is_promo.

    nodes: id, parent, alias, title. A page joins its parent's path level by level, each level a written table, however deep the
    tree is; the walk ends with a level without pages. Pages on a cycle or under an unknown parent hang on no root and don't appear.
    """
    children = nodes.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"), F.col("alias").alias("__alias"), F.col("title").alias("__title"))
    level = cut(nodes.where("parent IS NULL").select("id", F.concat(F.lit("/"), "alias").alias("path"), "title", F.col("alias").alias("section")).where(F.col("section").isin(*sections)), "site-level")
    walked = level
    while True:
        below = children.join(level, F.col("__parent") == F.col("id")).select(F.col("__id").alias("id"), F.concat("path", F.lit("/"), "__alias").alias("path"), F.col("__title").alias("title"), "section")
        level = cut(below, "site-level")
        if level.isEmpty():
            drop(level)
            break
        walked = walked.union(level)
    return walked.where(~F.col("path").rlike(skip)).select("path", "title", "section", F.lower("title").rlike(promo).alias("is_promo"))


def registry_cards(responses: DataFrame, payload: str) -> DataFrame:
    """Company cards from a lookup service's JSON, one for each suggestion, branches left out."""
    kind = "struct<suggestions:array<struct<value:string,data:struct<inn:string,ogrn:string,kpp:string,okved:string,branch_type:string,employee_count:int,name:struct<full_with_opf:string,short_with_opf:string>,management:struct<name:string>,state:struct<status:string>,address:struct<value:string>>>>>"
    rows = responses.select(F.explode(F.from_json(payload, kind)["suggestions"]).alias("s")).where(F.coalesce(F.col("s.data.branch_type"), F.lit("MAIN")) == "MAIN")
    d = F.col("s.data")
    return rows.select(
        d["inn"].alias("inn"), d["ogrn"].alias("ogrn"), d["kpp"].alias("kpp"), F.coalesce(d["name"]["full_with_opf"], F.col("s.value")).alias("name_full"), F.coalesce(d["name"]["short_with_opf"], F.col("s.value")).alias("name_short"),
        d["okved"].alias("okved"), d["address"]["value"].alias("address"), d["management"]["name"].alias("director"), d["employee_count"].alias("employees"), d["state"]["status"].alias("status"),
    )


def rates_by_title(pages: DataFrame, id_col: str, body: str, window: int = 6) -> DataFrame:
    """(page, title, rate) pairs of a page's lines where titles and rates stand on lines of their own.

    Whether rates follow or precede their titles is decided for each page by majority: the layout in which more rate
    lines have a title within the window. A rate goes to the nearest title in that direction.
    """
    from pyspark.sql import Window

    lines = pages.select(id_col, F.posexplode(F.split(body, "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    rate = F.when(F.col("line").rlike(r"\d\s*%") & (F.length("line") < 40), F.regexp_replace(F.regexp_extract("line", r"(\d+(?:[.,]\d+)?)\s*%", 1), ",", ".").try_cast("double"))
    marked = lines.withColumn("rate", rate).withColumn("title", F.when(F.col("rate").isNull() & F.col("line").rlike(r"(?U)^\p{Lu}\p{L}") & (F.length("line") < 80), F.struct("n", "line")))
    order = Window.partitionBy(id_col).orderBy("n")
    near = marked.withColumn("above", F.last("title", True).over(order.rowsBetween(-window, -1))).withColumn("below", F.first("title", True).over(order.rowsBetween(1, window))).where("rate is not null")
    votes = Window.partitionBy(id_col)
    down = F.count("above").over(votes) >= F.count("below").over(votes)
    return near.withColumn("of", F.when(down, F.col("above")).otherwise(F.col("below"))).where("of is not null").select(id_col, F.col("of.line").alias("title"), "rate", "n")


def ssr_state(page: Column) -> Column:
    """The escaped JSON of a server-rendered state script, unescaped."""
    raw = F.regexp_extract(page, r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1)
    for a, b in (("&q;", '"'), ("&l;", "<"), ("&g;", ">"), ("&s;", "'"), ("&a;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.when(raw != "", raw)
