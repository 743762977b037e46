"""Blind comparison of two models and paired statistics on its results.

Scores travel as one long table ``id, model, metric, value``, so a metric more is
rows more and never another plan.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.judging import DIMENSIONS, MODELS, WEIGHTS, dimension_score, not_nan, reply_json, winner
from passagemill.functions.keys import hash_mod
from passagemill.functions.text import collapse_spaces, norm
from passagemill.operators.encode import Encoder, cosine, encode_distinct, hashing_encoder
from passagemill.operators.positions import running_totals
from passagemill.operators.spread import computed_once, quantiles
from passagemill.session import stored

# ---- blinding and un-blinding ----------------------------------------------------------------


def blind(pairs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``id, question, A, B`` and the key ``id, A, B`` from ``id, question, base, dpo``; a coin per id."""
    heads = hash_mod(2, seed, F.col("id")) == 0
    shown = pairs.select(
        "id", "question", F.when(heads, F.col("base")).otherwise(F.col("dpo")).alias("A"), F.when(heads, F.col("dpo")).otherwise(F.col("base")).alias("B")
    )
    key = pairs.select(
        "id", F.when(heads, F.lit("base")).otherwise(F.lit("dpo")).alias("A"), F.when(heads, F.lit("dpo")).otherwise(F.lit("base")).alias("B")
    )
    return shown, key


def valid_keys(keys: DataFrame) -> DataFrame:
    """Key rows naming two known models; the last row of an id counts (``position`` orders them)."""
    sides = keys.select("id", "position", *[F.lower(collapse_spaces(F.col(s))).alias(s) for s in "AB"])
    known = sides.where(F.col("A").isin(*MODELS) & F.col("B").isin(*MODELS))
    return known.groupBy("id").agg(F.max_by(F.struct("A", "B"), "position").alias("k")).select("id", "k.A", "k.B")


def unblind(pairs: DataFrame, keys: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``id, question, base_answer, dpo_answer, reference`` of usable pairs.

    ``references`` is ``id, question, reference, position``; an id match wins over a question match.
    """
    rows = pairs.select("id", *[collapse_spaces(F.col(c)).alias(c) for c in ("question", "A", "B")])
    usable = rows.where((F.col("question") != "") & (F.col("A") != "") & (F.col("B") != ""))
    sides = valid_keys(keys).select("id", F.col("A").alias("_a"), F.col("B").alias("_b")).where(F.col("_a") != F.col("_b"))
    joined = usable.join(sides, "id")

    def answer(model: str) -> Column:
        return F.when(F.col("_a") == model, F.col("A")).otherwise(F.col("B"))

    out = joined.select("id", "question", answer("base").alias("base_answer"), answer("dpo").alias("dpo_answer"))
    if references is None:
        return out.withColumn("reference", F.lit(""))
    given = references.where(F.col("reference") != "")
    by_id = given.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("reference", "position").alias("_by_id"))
    asked = given.withColumn("question", collapse_spaces(F.col("question"))).where(F.col("question") != "")
    by_question = asked.groupBy("question").agg(F.max_by("reference", "position").alias("_by_question"))
    found = out.join(by_id, "id", "left").join(by_question, "question", "left")
    return found.select(
        "id", "question", "base_answer", "dpo_answer", F.coalesce("_by_id", "_by_question", F.lit("")).alias("reference")
    )


def judgements(replies: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per judged pair: ``id, parse_ok, winner_ab, winner_model, scores``.

    ``replies`` is ``id, raw``. An unreadable reply is kept as such and is no tie.
    """
    read = computed_once(replies.select("id", "raw"), _j=reply_json(F.col("raw"))).drop("raw")

    def field(path: str) -> Column:
        return F.get_json_object("_j", path)

    side = F.when(F.col("_j").isNotNull(), winner(field("$.winner")))
    scores = {"overall_score": [field(f"$.score_{s}").try_cast("double") for s in "ab"]}
    scores |= {d: [dimension_score(field(f"$.dimensions_{s}.{d}")) for s in "ab"] for d in DIMENSIONS}
    rows = read.select(
        "id",
        F.col("_j").isNotNull().alias("parse_ok"),
        side.alias("winner_ab"),
        F.array(*[F.struct(F.lit(m).alias("metric"), a.alias("a"), b.alias("b")) for m, (a, b) in scores.items()]).alias("scores"),
    ).join(valid_keys(keys), "id")
    picked = F.when(F.col("winner_ab") == "A", F.col("A")).when(F.col("winner_ab") == "B", F.col("B")).when(F.col("parse_ok"), F.lit("tie"))
    return rows.select("id", "parse_ok", "winner_ab", picked.alias("winner_model"), "scores", "A", "B")


def model_scores(judged: DataFrame) -> DataFrame:
    """Long scores ``id, model, metric, value`` of the judged pairs; missing scores stay null."""
    rows = judged.select("id", "A", "B", F.explode("scores").alias("s"))
    sides = F.array(F.struct(F.col("A").alias("model"), F.col("s.a").alias("value")), F.struct(F.col("B").alias("model"), F.col("s.b").alias("value")))
    return rows.select("id", F.col("s.metric").alias("metric"), F.explode(sides).alias("v")).select("id", "v.model", "metric", "v.value")


def unjudged(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("id").distinct(), "id", "left_anti")


# ---- summaries -------------------------------------------------------------------------------


def win_counts(judged: DataFrame) -> DataFrame:
    """One row of totals, wins, explicit ties and win rates; invalid replies are counted apart."""
    wins = {m: F.count_if(F.col("winner_model") == m) for m in (*MODELS, "tie")}
    row = judged.agg(
        F.count("*").alias("total_rows"),
        F.count_if("parse_ok").alias("valid_rows"),
        F.count_if(~F.col("parse_ok")).alias("invalid_rows"),
        *[c.alias(f"{m}_wins") for m, c in wins.items()],
    )
    decided = F.greatest(F.col("base_wins") + F.col("dpo_wins"), F.lit(1))
    return row.withColumns(
        {
            "dpo_win_rate_excl_tie": F.col("dpo_wins") / decided,
            "dpo_win_rate_incl_tie": F.col("dpo_wins") / F.greatest(F.col("total_rows"), F.lit(1)),
        }
    )


def winner_rates(judged: DataFrame) -> DataFrame:
    """Count and share of every outcome: base, dpo, tie, invalid."""
    total = judged.agg(F.count("*")).scalar()
    outcome = F.coalesce("winner_model", F.lit("invalid")).alias("outcome")
    return judged.groupBy(outcome).agg(F.count("*").alias("rows")).withColumn("share", F.col("rows") / total)


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean per metric and model over the values present, and the difference dpo - base."""
    value = not_nan(F.col("value").cast("double"))
    means = [F.avg(F.when(F.col("model") == m, value)).alias(f"{m}_mean") for m in MODELS]
    return scores.groupBy("metric").agg(*means).withColumn("delta", F.col("dpo_mean") - F.col("base_mean"))


def paired(scores: DataFrame) -> DataFrame:
    """``metric, id, base, dpo, diff`` of the rows where both models have a value."""
    value = not_nan(F.col("value").cast("double"))
    wide = scores.groupBy("metric", "id").agg(*[F.max(F.when(F.col("model") == m, value)).alias(m) for m in MODELS])
    both = wide.where(F.col("base").isNotNull() & F.col("dpo").isNotNull())
    return both.withColumn("diff", F.round(F.col("dpo") - F.col("base"), 12))


def paired_means(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("base").alias("base_mean"), F.avg("dpo").alias("dpo_mean"), F.avg("diff").alias("mean_diff")
    )


def weighted_scores(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``id, model, metric='weighted', value``: weights renormalised over the metrics present."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("metric"))
    value = not_nan(F.col("value").cast("double"))
    rows = scores.where(F.col("metric").isin(*weights)).select("id", "model", F.when(value.isNotNull(), weight).alias("w"), value.alias("v"))
    sums = rows.groupBy("id", "model").agg(F.sum(F.col("w") * F.col("v")).alias("total"), F.sum("w").alias("weight"))
    return sums.where(F.col("weight") > 0).select(
        "id", "model", F.lit("weighted").alias("metric"), F.round(F.col("total") / F.col("weight"), 12).alias("value")
    )


def risk_rates(scores: DataFrame, total: Column, threshold: float = 4.0, metrics: tuple[str, ...] = ("factual_consistency", "safety")) -> DataFrame:
    """Share of all judged rows whose score falls below the threshold, per metric and model."""
    low = scores.where(F.col("metric").isin(*metrics)).groupBy("metric", "model").agg(F.count_if(F.col("value") < threshold).alias("low"))
    return low.withColumn("rate", F.col("low") / total)


def preference_margins(scored: DataFrame) -> DataFrame:
    """Win share, mean and population deviation of ``chosen_logprob - rejected_logprob``."""
    margin = F.col("chosen_logprob") - F.col("rejected_logprob")
    return scored.where(margin.isNotNull()).agg(
        F.count("*").alias("n"),
        (F.count_if(margin > 0) / F.count("*")).alias("accuracy"),
        F.avg(margin).alias("mean_margin"),
        F.stddev_pop(margin).alias("std_margin"),
    )


STAGE_PROBS = {"p50": 0.50, "p90": 0.90}


def stage_profile(times: DataFrame, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """Count, mean, p50, p90 (half-even index rule), max, sum and share of the total per stage."""
    marks = quantiles(times, [stage], seconds, STAGE_PROBS, rule="half_even")
    sums = times.groupBy(stage).agg(
        F.count("*").alias("count"), F.avg(seconds).alias("avg"), F.max(seconds).alias("max"), F.sum(seconds).alias("sum")
    )
    total = F.coalesce(F.nullif(times.agg(F.sum(seconds)).scalar(), F.lit(0.0)), F.lit(1.0))
    return sums.join(marks, stage).withColumn("share", F.col("sum") / total * 100)


def slow_samples(times: DataFrame, n: int, seconds: str = "seconds", ties: str = "sample") -> DataFrame:
    return times.orderBy(F.col(seconds).desc(), F.col(ties)).limit(max(1, n))


# ---- similarity of answers -------------------------------------------------------------------

SIMILARITIES = (
    ("base_semantic_relevance", "question", "base_answer"),
    ("dpo_semantic_relevance", "question", "dpo_answer"),
    ("base_dpo_semantic_similarity", "base_answer", "dpo_answer"),
    ("base_reference_similarity", "reference", "base_answer"),
    ("dpo_reference_similarity", "reference", "dpo_answer"),
)


def similarities(rows: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Cosine of question, answers and reference per row; every different text is encoded once."""
    names = ("question", "base_answer", "dpo_answer", "reference")
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("text")) for n in names])
    texts = rows.select("id", F.explode(parts).alias("p")).select("id", "p.part", "p.text").where(norm(F.col("text")) != "")
    vectors = encode_distinct(texts, "text", encoder)
    found = texts.select("id", "part", F.md5(F.encode("text", "UTF-8")).alias("text_key")).join(vectors, "text_key")
    wide = found.groupBy("id").agg(*[F.max(F.when(F.col("part") == n, F.col("embedding"))).alias(n) for n in names])
    return wide.select("id", *[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), cosine(F.col(a), F.col(b))).alias(n) for n, a, b in SIMILARITIES])


# ---- significance ----------------------------------------------------------------------------


LEAF_VALUES = 4096  # distinct values whose counts a task draws at a time
DRAWN_AT_ONCE = 250_000  # counts of one such draw held in memory


def bootstrap_ci(pairs: DataFrame, resamples: int = 3000, seed: int = 42, leaf_values: int = LEAF_VALUES, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean difference per metric over resamples with replacement.

    A resample of n rows is drawn as counts of the distinct values, which stand in order and are cut into
    leaves of ``leaf_values``. Above them lies a binary tree: at each node the rows of a resample
    part into left and right by a binomial draw that only depends on the seed, the metric and the node, so
    every task below draws the same. A leaf walks its path from the root and parts what arrives
    over its own values. Exact, and no task holds more than one leaf of a metric at a time.
    """
    values = pairs.groupBy("metric", "diff").agg(F.count("*").alias("n"))
    placed = running_totals(values, ["metric"], ["diff"], F.lit(1), "place")
    placed = placed.withColumn("leaf", F.floor((F.col("place") - 1) / leaf_values).cast("long"))
    leaves = placed.groupBy("metric", "leaf").agg(F.sum("n").alias("size"))
    levels = leaves.groupBy("metric").agg(F.ceil(F.log2(F.max("leaf") + 1.0)).cast("int").alias("levels"))
    up = F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("up")
    # A node is a leaf number shifted right; its size is the sum over the leaves below it.
    above = leaves.join(levels, "metric").select("metric", "leaf", "size", up)
    nodes = above.groupBy("metric", "up", F.expr("shiftright(leaf, up)").alias("node")).agg(F.sum("size").alias("size"))
    left = nodes.where("node % 2 = 0").select("metric", (F.col("up") + 1).alias("up"), F.expr("shiftright(node, 1)").alias("node"), F.col("size").alias("left"))
    steps = above.select("metric", "leaf", "up", F.expr("shiftright(leaf, up)").alias("node")).where("up > 0").join(nodes, ["metric", "up", "node"]).join(left, ["metric", "up", "node"])
    goes_left = F.expr("shiftright(leaf, up - 1) % 2 = 0")
    # One step a level: the logarithm of the number of leaves.
    path = F.sort_array(F.collect_list(F.struct("up", "node", "size", "left", goes_left.alias("goes_left"))), asc=False)
    paths = steps.groupBy("metric", "leaf").agg(path.alias("path"))
    totals = leaves.groupBy("metric").agg(F.sum("size").alias("total"))

    def draw(key: tuple, rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        metric, leaf = key
        name, total = zlib.crc32(metric.encode()), int(way["total"].iloc[0])
        arriving = np.full(resamples, total, "int64")
        path = way["path"].iloc[0]
        for step in path if path is not None else ():
            rng = np.random.default_rng([seed, name, int(step["up"]), int(step["node"])])
            lefts = rng.binomial(arriving, step["left"] / step["size"])
            arriving = lefts if step["goes_left"] else arriving - lefts
        rows = rows.sort_values("diff")
        chance = rows["n"].to_numpy() / rows["n"].sum()
        rng = np.random.default_rng([seed, name, 0, int(leaf)])
        pieces = max(1, -(-resamples * len(rows) // DRAWN_AT_ONCE))
        sums = np.concatenate([rng.multinomial(part, chance) @ rows["diff"].to_numpy() for part in np.array_split(arriving, pieces)])
        return pd.DataFrame({"metric": metric, "resample": np.arange(resamples), "part": sums, "n": total})

    ways = leaves.select("metric", "leaf").join(totals, "metric").join(paths, ["metric", "leaf"], "left")
    ways = ways.select(F.col("metric").alias("of_metric"), F.col("leaf").alias("of_leaf"), "total", "path")
    drawn = placed.select("metric", "leaf", "diff", "n").groupBy("metric", "leaf").cogroup(ways.groupBy("of_metric", "of_leaf"))
    drawn = drawn.applyInPandas(draw, "metric string, resample int, part double, n long")
    means = drawn.groupBy("metric", "resample").agg((F.sum("part") / F.max("n")).alias("mean"))
    low = (1 - level) / 2
    # One row per resample: a fixed number per metric.
    return means.groupBy("metric").agg(F.percentile("mean", low).alias("ci_low"), F.percentile("mean", 1 - low).alias("ci_high"))


def _log_beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    total = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + numerator * d) or tiny)
            c = (1 + numerator / c) or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return total


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _log_beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _log_beta_fraction(b, a, 1 - x) / b


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of the smaller rank sum for n untied differences."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


@F.pandas_udf(T.DoubleType())
def _p_wilcoxon(w: pd.Series, z: pd.Series, n: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_exact(a, int(c)) if e else math.erfc(abs(b) / math.sqrt(2)) for a, b, c, e in zip(w, z, n, exact)])


@F.pandas_udf(T.DoubleType())
def _p_t(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b - 1) if b > 1 and not math.isnan(a) else math.nan for a, b in zip(t, n)])


EXACT_UP_TO = 50


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank sums per metric: zeros dropped, tied ranks averaged, tie-corrected z.

    Ranks come from counts of distinct absolute differences, summed along ranges of the
    values with about as many values each, so no task holds all differences of a metric.
    """
    size = F.abs("diff")
    signs = pairs.where(F.col("diff") != 0).groupBy("metric", size.alias("size")).agg(
        F.count_if(F.col("diff") > 0).alias("up"), F.count("*").alias("c")
    )
    ranked = running_totals(signs, ["metric"], ["size"], F.col("c"), "upto")
    rank = F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    ties = F.col("c") * (F.col("c") * F.col("c") - 1)
    sums = ranked.groupBy("metric").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum((F.col("c") - F.col("up")) * rank).alias("w_minus"),
        F.sum(ties).alias("ties"),
    )
    n = F.col("n")
    variance = (n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24
    w = F.least("w_plus", "w_minus")
    return sums.select("metric", "n", w.alias("w"), ((w - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"), (F.col("ties") > 0).alias("tied"))


def paired_t(pairs: DataFrame) -> DataFrame:
    sums = pairs.groupBy("metric").agg(
        F.count("*").alias("pairs"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s"), F.count_if(F.abs("diff") >= 1e-12).alias("moved")
    )
    # Equal differences have no spread: t is infinite with the sign of their mean.
    t = F.when((F.col("s") == 0) & (F.col("m") != 0), F.signum("m") * F.lit(float("inf"))).otherwise(F.col("m") / F.nullif(F.col("s") / F.sqrt("pairs"), F.lit(0.0)))
    return sums.select("metric", "pairs", "moved", t.alias("t"))


def significance(pairs: DataFrame) -> DataFrame:
    """Wilcoxon and paired-t p-values per metric; 1 when nothing moved, NaN below two pairs."""
    pairs = stored(pairs.select("metric", "diff"), "pairs")
    tests = paired_t(pairs).join(signed_rank(pairs), "metric", "left")
    exact = (F.col("n") <= EXACT_UP_TO) & ~F.col("tied") & (F.col("n") == F.col("pairs"))
    nan = F.lit(float("nan"))

    def guarded(p: Column) -> Column:
        return F.when(F.col("pairs") < 2, nan).when(F.col("moved") == 0, F.lit(1.0)).otherwise(p)

    filled = tests.withColumns({"n": F.coalesce("n", F.lit(0)), "w": F.coalesce("w", F.lit(0.0)), "z": F.coalesce("z", nan), "t": F.coalesce("t", nan)})
    return filled.select(
        "metric", "pairs", "n", "w", "z", "t",
        guarded(_p_wilcoxon("w", "z", "n", F.coalesce(exact, F.lit(False)))).alias("p_wilcoxon"),
        guarded(_p_t("t", "pairs")).alias("p_t"),
    )
