"""Event, digest and feedback queries. posts and events = the events table; votes = labels and event values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.operators import digest, matching, repeats
from ratelens.plans.registry import query
from ratelens.sources import sinks
from ratelens.sources.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("posts_anti_known", "SELECT event_id, user_id FROM events e WHERE ts >= TIMESTAMP '2024-01-16' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-03' AND k.user_id = e.user_id AND k.event_type = e.event_type)")
def posts_anti_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    fresh, known = rows.where("ts >= timestamp_ntz'2024-01-16'"), rows.where("ts < timestamp_ntz'2024-01-03'").select("user_id", "event_type").distinct()
    return fresh.join(known, ["user_id", "event_type"], "left_anti").select("event_id", "user_id")


@query("insert_or_ignore_posts", "SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16') EXCEPT SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'")
def insert_or_ignore_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts")
    return digest.unseen(rows.where("ts >= timestamp_ntz'2024-01-16'"), rows.where("ts < timestamp_ntz'2024-01-03'"), ["user_id", "event_type"]).select("user_id", "event_type")


@query(
    "daily_cards",
    """WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_type, event_id) AS place FROM events WHERE event_type <> 'click')
    SELECT day, place, event_id, value FROM r WHERE place <= 15""",
)
def daily_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest.daily_cards(events(spark, sf_dir).where("event_type <> 'click'"), F.date_format("ts", "yyyy-MM-dd"), [F.desc("value"), F.col("event_type"), F.col("event_id")])
    return rows.select("day", F.col("place").cast("long").alias("place"), "event_id", "value")


@query(
    "digest_top_k",
    """WITH t AS (SELECT event_type, event_id, value, length(props) AS size FROM events WHERE value >= 3), r AS (SELECT *, sum(size) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_size FROM t)
    SELECT event_type, event_id, value, running_size FROM r WHERE running_size <= 4000""",
)
def digest_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest.within_budget(events(spark, sf_dir).where("value >= 3"), ["event_type"], [F.desc("value"), F.col("event_id")], F.length("props"), 4000)
    return rows.select("event_type", "event_id", "value", "running_size")


@query("sent_once_filter", "WITH s AS (SELECT event_id FROM events WHERE event_type = 'purchase') SELECT event_id, value FROM events WHERE value > 50 AND event_id NOT IN (SELECT event_id FROM s)")
def sent_once_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    sent = rows.where("event_type = 'purchase'").select("event_id")
    return rows.where("value > 50").join(sent, "event_id", "left_anti").select("event_id", "value")


@query("slot_windows_4h", "SELECT strftime(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS slot_start, count(*) AS n, round(sum(value) + 1e-7, 2) AS total FROM events GROUP BY 1")
def slot_windows_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "4 hours")
    return events(spark, sf_dir).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-7, 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("slot_start"), "n", "total")


@query("daily_window_15h", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01 15:00:00'), '%Y-%m-%d %H:%M:%S') AS slot_start, count(*) AS n FROM events GROUP BY 1")
def daily_window_15h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.slots(events(spark, sf_dir), "ts", "1 day", "15 hours").select(F.date_format("slot_start", "yyyy-MM-dd HH:mm:ss").alias("slot_start"), "n")


@query("rolling_n_hours", "SELECT event_type, count(*) AS n, round(sum(value) + 1e-7, 2) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY 1")
def rolling_n_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ts").alias("last"))
    recent = rows.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 48 HOURS"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") + 1e-7, 2).alias("total"))


@query("slot_gap_wrap", "WITH h AS (SELECT DISTINCT hour(ts)::INT AS h FROM events WHERE hour(ts) % 5 = 0 OR hour(ts) = 7), s AS (SELECT h, coalesce(lead(h) OVER (ORDER BY h), (SELECT min(h) FROM h) + 24) - h AS gap FROM h) SELECT max(gap)::INT AS max_gap, count(*) AS slots FROM s")
def slot_gap_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.largest_gap(events(spark, sf_dir).select(F.hour("ts").alias("hour")).where("hour % 5 = 0 or hour = 7"))


VOTES = "votes AS (SELECT event_type AS category, user_id AS item, (1 + event_id % 5)::INT AS stars, (1 + floor(value)::BIGINT % 5)::INT AS vote FROM events)"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("category"), F.col("user_id").alias("item"), (1 + F.col("event_id") % 5).cast("int").alias("stars"), (1 + F.floor("value") % 5).cast("int").alias("vote"))


@query(
    "feedback_bias",
    f"""WITH {VOTES}, b AS (SELECT category, count(*) AS votes, round(avg(vote) + 1e-9, 3) AS mean_vote, round(avg(vote - stars) + 1e-9, 3) AS bias FROM votes GROUP BY 1)
    SELECT category, votes, mean_vote, bias, CASE WHEN bias >= 0.7 THEN 'underrated' WHEN bias <= -0.7 THEN 'overrated' ELSE 'fair' END AS verdict FROM b""",
)
def feedback_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.feedback_bias(votes(spark, sf_dir))


@query(
    "calibration_examples",
    f"""WITH {VOTES}, i AS (SELECT item, count(*) AS votes, avg(vote) AS m FROM votes WHERE category = 'purchase' GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT * FROM i WHERE (SELECT count(*) FROM i) >= 6),
    g AS (SELECT 'good' AS kind, * FROM e WHERE m >= 4 ORDER BY m DESC, item LIMIT 4), b AS (SELECT 'bad' AS kind, * FROM e WHERE m <= 2 ORDER BY m, item LIMIT 4)
    SELECT kind, item, votes, round(m + 1e-9, 3) AS mean_vote FROM g UNION ALL SELECT kind, item, votes, round(m + 1e-9, 3) FROM b""",
)
def calibration_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.calibration_examples(votes(spark, sf_dir).where("category = 'purchase'"), "item")


@query(
    "spend_null_sum",
    """SELECT user_id, sum(event_id % 100)::BIGINT AS tokens, count(CASE WHEN event_type <> 'click' THEN value END) AS priced,
    CASE WHEN count(*) FILTER (WHERE event_type = 'click' AND event_id % 100 > 0) = 0 THEN round(sum((event_id % 100) * CASE WHEN event_type <> 'click' THEN value END) + 1e-7, 2) END AS cost FROM events GROUP BY 1""",
)
def spend_null_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = events(spark, sf_dir).select("user_id", (F.col("event_id") % 100).alias("tokens"), F.when(F.col("event_type") != "click", F.col("value")).alias("price"))
    return digest.cost_by_run(usage, ["user_id"])


@query(
    "error_map_union",
    """WITH l AS (SELECT user_id, event_type, arg_max(event_id % 7, event_id) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || v, ';' ORDER BY event_type || '=' || v) AS errors FROM l GROUP BY 1""",
)
def error_map_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", (F.col("event_id") % 7).alias("v"), "event_id")
    return digest.merged_errors(rows, ["user_id"], "event_type", "v", "event_id")


@query("totals", "SELECT (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM documents) AS posts")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return a.crossJoin(F.broadcast(table(spark, sf_dir, "documents").agg(F.count("*").alias("posts"))))


@query("embedded_json_extract", "SELECT event_id, props ->> '$.k' AS k, length(props) AS size FROM events")
def embedded_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("size"))


@query("popularity_frontier", r"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages), c AS (SELECT target, count(*) AS \"references\", min(page_id) AS first_seen FROM l GROUP BY 1) SELECT target, \"references\", first_seen, row_number() OVER (ORDER BY \"references\" DESC, first_seen, target) AS place FROM c".replace('\\"', '"'))
def popularity_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))
    return digest.popularity(links, "target", "page_id").withColumn("place", F.col("place").cast("long"))


@query("dataset_fingerprint")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fingerprint(table(spark, sf_dir, "nation"), ["n_nationkey"])


#: Spelled names: two words of 8 letters and digits of a digest. Of every fourth customer one is altered, of every fourth five, and of every fourth the words change places.
_SPELLED = "concat(substr(md5(concat('n', {key})), 1, 8), ' ', substr(md5(concat('n', {key})), 9, 8))"
_ALTERED = "CASE {key} % 4 WHEN 0 THEN {n} WHEN 1 THEN concat(substr({n}, 1, 6), '-', substr({n}, 8)) WHEN 2 THEN concat(substr({n}, 10), ' ', substr({n}, 1, 8)) ELSE concat(substr({n}, 1, 3), '-----', substr({n}, 9)) END"
#: Cards: each supplier; each fourth has a branch of nearly its name and a union.
_CARDS = """SELECT s_suppkey, cn, concat('филиал общества с ограниченной ответственностью ', cn) AS fn FROM s UNION ALL SELECT -s_suppkey * 2 - 1, concat(substr(cn, 1, 15), 'xy'), NULL FROM s WHERE s_suppkey % 4 = 0
  UNION ALL SELECT -s_suppkey * 2 - 2, concat('профсоюз ', cn), NULL FROM s WHERE s_suppkey % 4 = 0"""


def _indel(a: str, b: str) -> str:
    """SQL of the Indel ratio: the longest common subsequence by rows of its table, each a running maximum over the row before."""
    step = f"list_max(list_transform(range(2, j + 1), lambda k: old[k - 1] + CASE WHEN ord({a}[k - 1]) = c[1] THEN 1 ELSE 0 END))"
    row = f"list_transform(range(1, length({a}) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(old[j], {step}) END)"
    rows = f"list_prepend(list_transform(range(length({a}) + 1), lambda z: 0::BIGINT), list_transform(string_split({b}, ''), lambda x: [ord(x)::BIGINT]))"
    return f"200.0 * list_reduce({rows}, lambda old, c: {row})[length({a}) + 1] / (length({a}) + length({b}))"


@query(
    "org_name_match",
    f"""WITH n AS (SELECT c_custkey, {_SPELLED.format(key="c_custkey")} AS n FROM customer), q AS (SELECT c_custkey, {_ALTERED.format(key="c_custkey", n="n")} AS qn FROM n),
    s AS (SELECT s_suppkey, {_SPELLED.format(key="s_suppkey")} AS cn FROM supplier), c AS ({_CARDS}),
    w AS (SELECT c_custkey, s_suppkey, qn, cn, array_to_string(list_sort(string_split(qn, ' ')), ' ') AS qs, array_to_string(list_sort(string_split(cn, ' ')), ' ') AS cs, fn IS NOT NULL AND len(list_filter(string_split(qn, ' '), lambda x: NOT list_contains(string_split(fn, ' '), x))) = 0 AS held FROM q, c),
    near AS (SELECT * FROM w WHERE held OR least(levenshtein(qn, replace(cn, 'профсоюз', 'zzzzzzzz')), levenshtein(qs, replace(cs, 'профсоюз', 'zzzzzzzz'))) <= 0.3 * (length(qn) + length(cn))),
    p AS (SELECT c_custkey, s_suppkey, cn LIKE 'профсоюз%' AS other, greatest(round({_indel("qn", "cn")}, 3), round({_indel("qs", "cs")}, 3), CASE WHEN held THEN 88 ELSE 0 END) AS raw FROM near),
    g AS (SELECT c_custkey, s_suppkey, other, CASE WHEN other THEN greatest(0, raw - 40) ELSE raw END AS score FROM p WHERE raw >= 70),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS place, row_number() OVER w AS n, lead(score) OVER w AS second, lead(other) OVER w AS second_other FROM g WINDOW w AS (PARTITION BY c_custkey ORDER BY other, score DESC, s_suppkey)),
    b AS (SELECT *, CASE WHEN second IS NULL OR (second_other AND NOT other) THEN score >= 85 ELSE score >= 90 AND score - second >= 15 END AS good FROM r WHERE n = 1),
    t AS (SELECT c_custkey, string_agg(s_suppkey::VARCHAR, ',' ORDER BY place) AS candidates FROM r WHERE place <= 3 GROUP BY 1)
    SELECT c_custkey, s_suppkey, score, CASE WHEN good THEN 'accepted' ELSE 'needs_review' END AS decision, candidates FROM customer LEFT JOIN b USING (c_custkey) LEFT JOIN t USING (c_custkey)""",
)
def org_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name, typing errors and all, against a registry of suppliers, their branches and unions."""
    q = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SPELLED.format(key="c_custkey")).alias("n")).select("c_custkey", F.expr(_ALTERED.format(key="c_custkey", n="n")).alias("qn"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_SPELLED.format(key="s_suppkey")).alias("cn"))
    c = spark.sql(f"WITH s AS (SELECT * FROM {{s}}) {_CARDS}", s=s)
    found = matching.match_names(q, c, "c_custkey", "qn", "s_suppkey", "cn", "fn")
    return found.withColumn("candidates", F.array_join("candidates", ","))


def part_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new events, events of earlier days, outside verdicts) made from parts: four tellings for every four parts, each 13th of an earlier day."""
    firm = "substr(md5(concat('f', p_partkey DIV 8)), 1, 9)"
    rows = table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS BIGINT) AS id",
        f"CASE p_partkey % 4 WHEN 0 THEN concat('Завод ', {firm}, ' открыл новый цех в городе') WHEN 1 THEN concat('Компания ', {firm}, ' запустила производство ', lower(p_brand)) WHEN 2 THEN concat({firm}, ' судится из-за ', lower(p_type)) ELSE concat('Погода в районе ', p_partkey DIV 40, ': дождь и ветер до ', p_size) END AS title",
        "CASE p_partkey % 4 WHEN 3 THEN '' ELSE concat('Подробности о событии сообщили в компании: ', p_name, ', ', p_type) END AS summary",
        f"CASE WHEN p_partkey % 4 < 3 THEN array(named_struct('name', concat('ООО ', {firm}, CASE WHEN p_partkey % 4 = 1 THEN 'z' ELSE '' END), 'inn', CAST(NULL AS STRING))) ELSE array() END AS organizations",
        "CASE WHEN p_partkey % 4 < 2 THEN array(concat(90 + p_partkey DIV 4 % 7, ' млн рублей')) ELSE array() END AS amounts",
        "CASE WHEN p_partkey % 16 = 2 THEN p_size END AS employees",
        "CAST(NULL AS STRING) AS card_inn",
        "p_size % 5 + 1 AS relevance",
        "array(concat('u', p_partkey)) AS source_urls",
        "array(p_brand) AS channels",
        "array(concat('p', p_partkey)) AS post_keys",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('img', p_partkey) END AS image_url",
    )
    earlier = F.col("id") % 13 == 0
    near = rows.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") - 8, F.col("id") + 8)).alias("b")).where("a < b")
    return rows.where(~earlier), rows.where(earlier), near.select("a", "b", ((F.col("a") + F.col("b")) % 3 == 0).alias("same"))


@query("repeated_events")
def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each new event under a budget of 15 verdicts; heads carry the sources of those that joined them."""
    new, earlier, answers = part_events(spark, sf_dir)
    state, paid = repeats.distinct_events(new, earlier, answers)
    asked = spark.createDataFrame([(i + 1, x, y, s) for i, (x, y, s) in enumerate(paid)], "asked int, x long, y long, same boolean")
    merged = repeats.merged_events(new, state).select(F.col("id").alias("head"), F.size("source_urls").alias("sources"), F.col("relevance").alias("head_relevance"), "image_url")
    first = asked.groupBy(F.greatest("x", "y").alias("id")).agg(F.min("asked").alias("asked"))
    return state.join(merged, "head").join(first, "id", "left").select("id", "head", "event", "status", "sources", "head_relevance", "image_url", "asked")
