"""Market position: who leads a program, where the home bank stands, how far it is from the others.

Every operator first reduces offers to one best value for each (program, bank); that aggregation combines map-side
and is the only shuffle over raw offers. All that follows works on the reduced frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of statuses in reports: what needs attention first.
STATUS_ORDER = ("behind", "not_found", "absent", "in_market", "leader", "no_rivals", "no_data")


def best_by_bank(offers: DataFrame, higher_is_better: bool = True, value: str = "rate") -> DataFrame:
    """(program, bank, value): the best known value of each bank in each program."""
    pick = F.max if higher_is_better else F.min
    return offers.where(F.col(value).isNotNull()).groupBy("program", "bank").agg(pick(value).alias("value"))


def best_offer_rows(offers: DataFrame, seq: list[str], higher_is_better: bool = True, value: str = "rate") -> DataFrame:
    """The winning offer of each (program, bank) with its keys; ties go to the first by `seq`."""
    signed = F.col(value) if higher_is_better else -F.col(value)
    best = F.min(F.struct((-signed).alias("v"), *seq)).alias("b")
    return offers.where(F.col(value).isNotNull()).groupBy("program", "bank").agg(best, F.count("*").alias("offers")).select("program", "bank", "offers", *[F.col(f"b.{c}").alias(c) for c in seq], (-F.col("b.v") if higher_is_better else F.col("b.v")).alias("value"))


def market_position(best: DataFrame, home: Column, parity: float = 0.5, higher_is_better: bool = True) -> DataFrame:
    """One row for each program.

    rank is 1 + the number of banks strictly better than the home bank (ties share it); others_median is the
    median of the other banks; advantage is the distance to it in the home bank's favour.
    """
    is_home = F.col("bank") == home
    marked = best.withColumn("home_value", F.max(F.when(is_home, F.col("value"))).over(Window.partitionBy("program")))
    better = F.col("value") > F.col("home_value") if higher_is_better else F.col("value") < F.col("home_value")
    pick = F.max if higher_is_better else F.min
    rows = marked.groupBy("program").agg(
        F.first("home_value").alias("home_value"),
        pick("value").alias("best_value"),
        F.round(F.median(F.when(~is_home, F.col("value"))), 3).alias("others_median"),
        F.count("*").alias("banks_compared"),
        F.count_if(~is_home).alias("others"),
        (F.lit(1) + F.count_if(better)).alias("rank"),
    )
    sign = 1 if higher_is_better else -1
    rows = rows.withColumn("delta_best", F.round(F.col("home_value") - F.col("best_value"), 3)).withColumn("advantage", F.round(sign * (F.col("home_value") - F.col("others_median")), 3))
    rows = rows.withColumn("rank", F.when(F.col("home_value").isNotNull(), F.col("rank")))
    status = (
        F.when(F.col("home_value").isNull(), F.when(F.col("others") > 0, "not_found").otherwise("no_data"))
        .when(F.col("others") == 0, "no_rivals")
        .when(F.col("rank") == 1, "leader")
        .when(F.col("advantage") >= -parity, "in_market")
        .otherwise("behind")
    )
    return rows.withColumn("status", status).drop("others")


def in_report_order(positions: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return positions.orderBy(order, "program")


def leader_gap(best: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """program, leader, leader_value, runner_up_value, gap; ties between banks go to the lower bank."""
    signed = F.col("value").desc() if higher_is_better else F.col("value")
    w = Window.partitionBy("program").orderBy(signed, "bank")
    ranked = best.withColumn("place", F.row_number().over(w)).withColumn("runner_up_value", F.lead("value").over(w))
    return ranked.where("place = 1").select("program", F.col("bank").alias("leader"), F.col("value").alias("leader_value"), "runner_up_value", F.round(F.abs(F.col("value") - F.col("runner_up_value")), 3).alias("gap"))


def showcase_rate(low: Column, high: Column, higher_is_better: Column | bool) -> Column:
    """The bound of a rate range that is advertised and compared: the upper one for savings, the lower one for loans; the other one where that is missing."""
    better = F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better
    return F.when(better, F.coalesce(high, low)).otherwise(F.coalesce(low, high))


def traffic_light(best: DataFrame, home: Column, parity: float = 0.5, loss: float = 1.0, higher_is_better: bool = True) -> DataFrame:
    """Home bank against every rival of a program: delta and light (red, yellow, green; grey without a home value)."""
    mine = best.where(F.col("bank") == home).select("program", F.col("value").alias("home_value"))
    rivals = best.where(F.col("bank") != home).join(mine, "program", "left")
    delta = F.round(F.col("home_value") - F.col("value"), 3)
    advantage = F.col("delta") if higher_is_better else -F.col("delta")
    light = F.when(F.col("delta").isNull(), "grey").when(F.abs("delta") < parity, "yellow").when(advantage > 0, "green").when(F.abs("delta") >= loss, "red").otherwise("yellow")
    return rivals.withColumn("delta", delta).withColumn("light", light).select("program", "bank", "home_value", F.col("value").alias("rival_value"), "delta", "light")


def dense_counts(rows: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of every listed value of `key`, zero where there is none."""
    spark = rows.sparkSession
    listed = spark.sql(f"SELECT explode(array({', '.join(repr(v) for v in values)})) AS {key}")
    return F.broadcast(listed).join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(best: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Deviation of each bank from the program's median of all banks, and its colour level -3..3."""
    middle = F.median("value").over(Window.partitionBy("program"))
    sign = 1 if higher_is_better else -1
    rows = best.withColumn("advantage", F.round(sign * (F.col("value") - middle), 3))
    level = F.when(F.abs("advantage") >= 0.25, F.least(F.lit(3), F.floor(F.abs("advantage") / 0.5 + 0.5)) * F.signum("advantage")).otherwise(0)
    return rows.select("program", "bank", "value", "advantage", level.cast("int").alias("level"))


def status_share(positions: DataFrame, block: str = "block") -> DataFrame:
    """Share of each status within a block, in percent with one decimal."""
    counts = positions.groupBy(block, "status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(block))
    return counts.select(block, "status", "n", F.round(100.0 * F.col("n") / total, 1).alias("share_pct"))


def positioning(best: DataFrame, is_savings: Column) -> DataFrame:
    """Each bank's mean savings and loan values and number of programs, with the medians over banks as axes."""
    marked = best.withColumn("savings", is_savings)
    banks = marked.groupBy("bank").agg(F.round(F.avg(F.when(F.col("savings"), F.col("value"))), 3).alias("savings_mean"), F.round(F.avg(F.when(~F.col("savings"), F.col("value"))), 3).alias("loan_mean"), F.count("*").alias("programs"))
    axes = banks.agg(F.round(F.median("savings_mean"), 3).alias("savings_axis"), F.round(F.median("loan_mean"), 3).alias("loan_axis"))
    return banks.crossJoin(F.broadcast(axes))


def common_programs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides in the programs that both have."""
    shared = a.select("program").intersect(b.select("program"))
    return a.join(shared, "program", "left_semi").unionByName(b.join(shared, "program", "left_semi"))


def segment_verdict(best_home: DataFrame, best_rival: DataFrame, candidates: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """For each segment the first kind of benefit, by priority, that both sides have decides: green, yellow or red; else grey.

    best_* hold (segment, kind, value); candidates hold (kind, priority).
    """
    both = best_home.withColumnRenamed("value", "home_value").join(best_rival.withColumnRenamed("value", "rival_value"), ["segment", "kind"]).join(F.broadcast(candidates), "kind")
    first = both.groupBy("segment").agg(F.min_by(F.struct("kind", "home_value", "rival_value"), "priority").alias("d")).select("segment", "d.*")
    sign = F.when(F.col("kind").isin(*lower_is_better), -1).otherwise(1) if lower_is_better else F.lit(1)
    edge = sign * (F.col("home_value") - F.col("rival_value"))
    decided = first.withColumn("verdict", F.when(edge == 0, "yellow").when(edge > 0, "green").otherwise("red"))
    segments = best_home.select("segment").union(best_rival.select("segment")).distinct()
    return segments.join(decided, "segment", "left").withColumn("verdict", F.coalesce("verdict", F.lit("grey")))


def in_catalogue_order(products: DataFrame, categories: tuple[str, ...], group: str, category: str, title: str, product: str) -> DataFrame:
    """Place of each product in its group: categories in a fixed order, others last, then by title without case."""
    listed = F.array_position(F.array(*map(F.lit, categories)), F.col(category))
    order = F.when(listed > 0, listed).otherwise(len(categories) + 1)
    return products.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, F.lower(title), product)))


def in_choice_order(programs: DataFrame, preferred: tuple[str, ...], group: str) -> DataFrame:
    """Place of each program in its group: those that two or more offer first, then preferred ones, then by kind and name."""
    listed = F.array_position(F.array(*map(F.lit, preferred)), F.col("program"))
    order = [-F.least(F.col("offers"), F.lit(2)), F.when(listed > 0, listed).otherwise(len(preferred) + 1), F.col("kind"), F.col("program")]
    return programs.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
