"""Extraction of facts by an outside model, as data: what is sent, what is known already, and which answers hold.

The cache is a table of answers named by content: the digest of the squeezed source, the version of the question and the model. A
run joins its requests with it; what is missing is asked once for each different source, however many documents share it, and
appended. Appending what is there already changes nothing, so a run that is repeated asks for nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import text
from ratelens.sources.ranges import numbered

#: Characters of a text that is worth a question, and of a quote.
MIN_TEXT, MIN_QUOTE, MAX_QUOTE = 500, 8, 400
# Quotes that read like orders to a model, what a field's quote has to be about, units of numbers, words for yes and no.
INJECTION = r"(?iu)игнорир|забудь|инструкци|верни |ответь|выведи|system prompt|ignore (all|previous|the)|disregard|you are |ты —|ты -|от имени|jailbreak|\bпромпт"
TOPIC = {
    "capitalization": "капитализ",
    "topup_allowed": "пополн",
    "withdrawal_allowed": "снят|расходн",
    "early_termination": "досрочн|расторж",
    "payout": "выплат|начисл|процент",
    "term": "срок|мес|дн|год|лет",
    "min_amount": r"сумм|₽|руб|от \d|минимальн",
    "max_amount": r"сумм|₽|руб|до \d|максимальн",
}
NUMERIC_UNITS = ("% годовых", "%", "₽", "мес", "дней", "шт", "п.п.")
YES, NO = ("да", "yes", "true"), ("нет", "no", "false")
UNKNOWN = "н/д"


def squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def relevant_lines(value: Column, most: int = 12_000) -> Column:
    """A long text's lines with digits and their neighbours, in order, until the next one would exceed `most` characters; a short text as it is."""

    def cut(lines: Column, digits: Column) -> Column:
        def near(i: Column) -> Column:
            return F.coalesce(F.get(digits, i), F.lit(False)) | F.coalesce(F.get(digits, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, F.get(digits, F.greatest(i - 1, F.lit(0)))), F.lit(False))

        kept = F.filter(lines, lambda line, i: near(i))
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("lines"), F.lit(False).alias("full"))

        def take(s: Column, line: Column) -> Column:
            size = s["size"] + F.length(line) + 1
            full = s["full"] | (size > most)
            return F.struct(F.when(full, s["size"]).otherwise(size).alias("size"), (s["lines"] + F.when(full, 0).otherwise(1)).alias("lines"), full.alias("full"))

        return F.array_join(F.slice(kept, F.lit(1), F.aggregate(kept, start, take)["lines"]), "\n")

    # Made once, named inside.
    parts = F.transform(F.array(F.split(value, "\r?\n")), lambda x: F.struct(x.alias("lines"), F.transform(x, lambda line: line.rlike(r"\d")).alias("digits")))
    return F.when(F.length(value) <= most, value).otherwise(F.transform(parts, lambda p: cut(p["lines"], p["digits"]))[0])


def source_key(source: Column) -> Column:
    """Names a source by content: equal but for blanks, equal keys."""
    return F.sha2(squeezed(source), 256)


def send_plan(docs: DataFrame, known: DataFrame, order: list[Column], origins: list[str], budget: int, version: str) -> DataFrame:
    """Adds reason: why a document isn't sent to the model (first that applies), or null if it is.

    docs: doc, product, origin, official (of its host), content_type, sha256, text; known: doc, sha256, version of what was extracted.
    In the given order `budget` of the documents that nothing else holds back are sent; the rest is over the budget. The order is a
    range sort, so no task sees more than its range.
    """
    done = known.where(F.col("version") == version).select("doc", "sha256", F.lit(True).alias("__done")).distinct()
    rows = docs.join(done, ["doc", "sha256"], "left")
    official = F.col("origin").isin(*origins) & F.coalesce("official", F.lit(False))
    reason = (
        F.when(F.col("product").isNull(), "no_product")
        .when(~F.coalesce(official, F.lit(False)), "not_official")
        .when(~F.startswith(F.coalesce("content_type", F.lit("")), F.lit("text/html")), "not_html")
        .when(F.col("__done"), "known")
        .when(F.length(F.coalesce("text", F.lit(""))) < MIN_TEXT, "too_short")
    )
    judged = rows.withColumn("reason", reason).drop("__done")
    placed = numbered(judged, [F.col("reason").isNotNull(), *order], "__place")
    return placed.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("__place") >= budget), "budget").otherwise(F.col("reason"))).drop("__place")


class AnswerCache:
    """Answers (key, version, model, answer) in a parquet folder that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema("key string, version string, model string, answer string").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "key string, version string, model string, answer string")

    def lookup(self, requests: DataFrame, version: str, model: str) -> DataFrame:
        """requests (with a column source) with key, answer and hit."""
        answers = self.read().where((F.col("version") == version) & (F.col("model") == model)).groupBy("key").agg(F.min("answer").alias("answer"), F.lit(True).alias("hit"))
        return requests.withColumn("key", source_key(F.col("source"))).join(answers, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def missing(self, looked_up: DataFrame) -> DataFrame:
        """(key, source, documents) to ask for: one for each different source without an answer."""
        return looked_up.where("not hit").groupBy("key").agg(F.min("source").alias("source"), F.count("*").alias("documents"))

    def append(self, answers: DataFrame, version: str, model: str) -> None:
        """Adds answers (key, answer) that aren't there: of several for a key the first by text, none for a key that has one, none without text."""
        known = self.read().where((F.col("version") == version) & (F.col("model") == model)).select("key")
        fresh = answers.where("answer IS NOT NULL").groupBy("key").agg(F.min("answer").alias("answer")).join(known, "key", "left_anti")
        fresh.select("key", F.lit(version).alias("version"), F.lit(model).alias("model"), "answer").write.mode("append").parquet(self.path)


def quote_problem(quote: Column, folded_quote: Column, folded_source: Column, topic: Column, value: Column) -> Column:
    """Why a quote doesn't support a value, or null: its length, whether the source has it, orders to a model, its topic (a pattern), the value's numbers.

    folded_*: by text.folded(). topic and value may be null: then they aren't judged.
    """
    amounts = F.array_except(_numbers(text.folded(F.coalesce(value, F.lit("")))), _numbers(folded_quote))
    return (
        F.when(F.length(F.coalesce(folded_quote, F.lit(""))) < MIN_QUOTE, "too_short")
        .when(F.length(quote) > MAX_QUOTE, "too_long")
        .when(~F.coalesce(F.contains(folded_source, folded_quote), F.lit(False)), "not_in_source")
        .when(folded_quote.rlike(INJECTION), "injection")
        .when(topic.isNotNull() & ~F.regexp_like(folded_quote, F.coalesce(topic, F.lit(""))), "off_topic")
        .when(F.size(amounts) > 0, "numbers_missing")
    )


def _numbers(folded: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(folded, F.lit(r"(\d[\d ]*(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.replace(F.replace(n, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))))


def canonical_value(value: Column, unit: Column) -> Column:
    """A value in its unit's form: plain decimals for numbers, yes or no for bool, text as it is; null if it has none."""
    bare = F.trim(value)
    digits = F.rtrim(F.replace(F.regexp_replace(bare, r"[  ]", ""), F.lit(","), F.lit(".")), F.lit("%₽"))
    decimal = digits.try_cast("decimal(30,10)")
    plain = F.regexp_replace(F.regexp_replace(decimal.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    low = F.lower(bare)
    truth = F.when(low.isin(*YES), "yes").when(low.isin(*NO), "no")
    return F.when(low == UNKNOWN, UNKNOWN).when(unit.isin(*NUMERIC_UNITS), plain).when(unit == "bool", truth).otherwise(F.nullif(bare, F.lit("")))


def checked_items(items: DataFrame, parameters: DataFrame) -> DataFrame:
    """items (parameter, unit, value, evidence, source) with canonical and problem: unknown_parameter, unit_mismatch, bad_value, evidence_not_found, or null.

    parameters: parameter, expected (its unit), one row each.
    """
    known = parameters.select("parameter", "expected", F.lit(True).alias("__known"))
    rows = items.join(known, "parameter", "left").withColumn("canonical", F.when(F.col("__known"), canonical_value(F.col("value"), F.col("expected"))))
    quote = F.lower(squeezed(F.col("evidence")))
    held = (quote != "") & F.contains(F.lower(squeezed(F.col("source"))), quote)
    mismatch = (F.coalesce("unit", F.lit("")) != "") & ~F.col("expected").isin("text", "bool") & (F.trim("unit") != F.col("expected"))
    problem = F.when(F.col("__known").isNull(), "unknown_parameter").when(mismatch, "unit_mismatch").when(F.col("canonical").isNull(), "bad_value").when(~held, "evidence_not_found")
    return rows.withColumn("problem", problem).drop("__known", "expected")
