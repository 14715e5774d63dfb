"""Complete error paths of pairs, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdictlake.functions import enums as E
from verdictlake.functions.exprs import arrows, error_combination, share, share_within
from verdictlake.operators.pairs import PAIR
from verdictlake.operators.profiles import classified, profiles_of_pairs


def pair_steps(fact: DataFrame) -> DataFrame:
    """One row a pair: its verdicts in order of date, then ``submission_id``. One shuffle of the log."""
    steps = F.array_sort(F.collect_list(F.struct("date", "submission_id", "status_code")))
    return fact.groupBy(*PAIR, "difficulty").agg(F.transform(steps, lambda s: s["status_code"]).alias("steps"))


def users_of(steps: DataFrame, least: int = E.MIN_SUBMISSIONS) -> DataFrame:
    """(user_id, proficiency_group) of the classified users among the pairs."""
    tried = steps.select(*PAIR, "difficulty", F.size("steps").alias("n"), F.array_contains("steps", E.ACCEPTED).alias("solved"))
    return classified(profiles_of_pairs(tried).where(F.col("total_raw_submissions") >= least))


def paths_of(steps: DataFrame, users: DataFrame) -> DataFrame:
    """One row a pair that starts with an error: verdicts up to the first AC, or all if there is none."""
    failed = steps.where(F.element_at("steps", 1) != E.ACCEPTED).join(users, "user_id")
    at = F.array_position("steps", E.ACCEPTED).cast("int")
    cut = failed.withColumn("steps", F.when(at > 0, F.slice("steps", 1, at)).otherwise(F.col("steps")))
    return cut.select(
        *PAIR,
        "difficulty",
        "proficiency_group",
        F.element_at("steps", 1).alias("first_error"),
        F.array_join("steps", E.ARROW).alias("sequence"),
        F.size("steps").alias("sequence_length"),
        (F.element_at("steps", -1) == E.ACCEPTED).alias("resolved"),
    )


def error_paths(log_fact: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Counts of each path and its share within level, group and first error.

    Unless ``users`` names the cohort, groups are read from the pairs' verdicts like the paths, so the log is
    scanned and shuffled once. Rows have no order, as the table grows with the data.
    """
    steps = pair_steps(log_fact)
    return path_counts(paths_of(steps, users_of(steps) if users is None else users))


def path_counts(pair_paths: DataFrame) -> DataFrame:
    keys = ["difficulty", "proficiency_group", "first_error"]
    counts = pair_paths.groupBy(*keys, "sequence", "sequence_length", "resolved").agg(F.count("*").alias("n_pairs"))
    return counts.withColumn("proportion_pct", share_within("n_pairs", keys))


def top_paths(paths: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most common paths by ``keys``; ties by the path. The window keeps no more than ``k`` a group."""
    summed = paths.groupBy(*keys, "sequence", "resolved").agg(F.sum("n_pairs").alias("n_pairs"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n_pairs"), "sequence"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= k)


def top_paths_with_others(paths: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most common paths with their share, and one row "Others" for the rest of each group."""
    summed = paths.groupBy(*keys, "sequence").agg(F.sum("n_pairs").alias("n_pairs"))
    group = Window.partitionBy(*keys)
    rank = F.row_number().over(group.orderBy(F.desc("n_pairs"), "sequence"))
    ranked = summed.withColumn("rank", rank).withColumn("total", F.sum("n_pairs").over(group))
    name = F.when(F.col("rank") <= k, F.col("sequence")).otherwise(F.lit("Others"))
    folded = ranked.groupBy(*keys, name.alias("sequence"), F.least("rank", F.lit(k + 1)).alias("rank"), "total").agg(F.sum("n_pairs").alias("n_pairs"))
    return folded.select(*keys, "sequence", "rank", "n_pairs", share(F.col("n_pairs"), F.col("total"), 1).alias("pct"))


def error_combos(paths: DataFrame) -> DataFrame:
    """Resolution by the combination of distinct errors met, by group; paths of ``Other`` only are left out."""
    told = paths.withColumn("combo", error_combination(F.col("sequence"))).where("combo is not null")
    resolved = F.sum(F.when(F.col("resolved"), F.col("n_pairs")).otherwise(0))
    return told.groupBy("combo", "proficiency_group").agg(F.sum("n_pairs").alias("total"), resolved.alias("n_resolved")).withColumn("rate", share(F.col("n_resolved"), F.col("total"), 1))


def frequent_combos(combos: DataFrame, least: int = 50, small: int = 20) -> DataFrame:
    """Combinations of at least ``least`` pairs over all groups, each with its groups; small samples are flagged."""
    overall = F.sum("total").over(Window.partitionBy("combo"))
    return combos.withColumn("combo_total", overall).where(F.col("combo_total") >= least).withColumn("small_sample", F.col("total") <= small).orderBy(F.desc("combo_total"), "combo", "proficiency_group")


def transitions(paths: DataFrame, least: int = 1, depth: int = 6, by: tuple[str, ...] = (), **only: str) -> DataFrame:
    """Edges of the flow from step to step, weighted by pairs; one flow for each value of ``by``.

    Paths below ``least`` pairs are left out; unresolved ones end in "Abandon"; at most ``depth`` steps
    are followed. A step is named with its position, except the two ends.
    """
    chosen = paths.where(F.col("n_pairs") >= least)
    for column, value in only.items():
        chosen = chosen.where(F.col(column) == value)
    steps = F.split("sequence", E.ARROW)
    whole = F.when(F.col("resolved"), steps).otherwise(F.concat(steps, F.array(F.lit(E.ABANDON))))
    cut = chosen.select(*by, "n_pairs", F.slice(whole, 1, depth + 1).alias("steps")).where(F.size("steps") > 1)
    hop = cut.select(*by, "n_pairs", "steps", F.explode(F.sequence(F.lit(1), F.size("steps") - 1)).alias("i"))
    node = lambda at: F.when(F.element_at("steps", at).isin(E.ACCEPTED, E.ABANDON), F.element_at("steps", at)).otherwise(F.concat_ws("_p", F.element_at("steps", at), at.cast("string")))
    return hop.select(*by, node(F.col("i")).alias("source"), node(F.col("i") + 1).alias("target"), "n_pairs").groupBy(*by, "source", "target").agg(F.sum("n_pairs").alias("value"))


def flow_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes of the flow."""
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def resolution_by_length(paths: DataFrame, least: int = 5) -> DataFrame:
    """Resolution by number of retries, five and more as one, by group; small cells are left out."""
    sized = paths.withColumn("length", F.least(arrows(F.col("sequence")), F.lit(5))).where("length >= 1")
    resolved = F.sum(F.when(F.col("resolved"), F.col("n_pairs")).otherwise(0))
    cells = sized.groupBy("proficiency_group", "length").agg(F.sum("n_pairs").alias("total"), resolved.alias("n_resolved"))
    return cells.where(F.col("total") >= least).withColumn("rate", share(F.col("n_resolved"), F.col("total"), 1))
