"""Judge replies, blind comparison and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.functions import judging as J
from passagemill.functions.keys import hash_mod
from passagemill.operators import encode as E
from passagemill.operators import spread, stats
from passagemill.plans import inputs
from passagemill.registry import Registry, duck
from passagemill.session import read_table

area = Registry()


def _q(text: str) -> str:
    return f"'{text}'"


MESSAGES = "msgs AS (SELECT conv_id * 1000000 + turn AS id, conv_id, turn, role, text FROM conversations)"
_dim = "{{ 'metric': '{m}', 'side': '{s}', 'value': CASE WHEN {miss} = 0 THEN NULL ELSE greatest(1.0::double, least(5.0::double, {v}::double)) END }}"
_cells = ", ".join(
    [f"{{ 'metric': 'overall_score', 'side': '{s}', 'value': ({duck.hash_mod(10, _q('overall_score'), _q(s), 'id')} + 1)::double }}" for s in "ab"]
    + [
        _dim.format(m=m, s=s, miss=duck.hash_mod(20, _q("miss"), _q(m), _q(s), "id"), v=duck.hash_mod(7, _q(m), _q(s), "id"))
        for m in J.DIMENSIONS
        for s in "ab"
    ]
)
JUDGED = (
    MESSAGES,
    f"""keyed AS (SELECT id, CASE WHEN {duck.hash_mod(2, _q('42'), 'id')} = 0 THEN 'base' ELSE 'dpo' END AS a_model,
      {duck.hash_mod(33, _q('format'), 'id')} <> 0 AS parse_ok, list_extract(['A', 'B', 'TIE', 'TIE'], {duck.hash_mod(4, _q('winner'), 'id')} + 1) AS w FROM msgs)""",
    """judged AS (SELECT id, parse_ok, CASE WHEN parse_ok THEN w END AS winner_ab, CASE WHEN NOT parse_ok THEN NULL WHEN w = 'TIE' THEN 'tie'
      WHEN (w = 'A') = (a_model = 'base') THEN 'base' ELSE 'dpo' END AS winner_model, a_model FROM keyed)""",
    f"cells AS (SELECT id, unnest([{_cells}]) AS c FROM msgs)",
    """scores AS (SELECT id, CASE WHEN (c.side = 'a') = (a_model = 'base') THEN 'base' ELSE 'dpo' END AS model, c.metric AS metric,
      CASE WHEN parse_ok THEN c.value END AS value FROM cells JOIN judged USING (id))""",
    """paired AS (SELECT metric, id, max(value) FILTER (WHERE model = 'base') AS base, max(value) FILTER (WHERE model = 'dpo') AS dpo FROM scores GROUP BY metric, id),
    diffs AS (SELECT *, round(dpo - base, 12) AS diff FROM paired WHERE base IS NOT NULL AND dpo IS NOT NULL)""",
)


def _key(spark, folder):
    _, key = stats.blind(inputs.blind_pairs(spark, folder), 42)
    return key.withColumn("position", F.col("id"))


def _judged(spark, folder):
    return stats.judgements(inputs.judge_replies(spark, folder), _key(spark, folder))


def _scores(spark, folder):
    return stats.model_scores(_judged(spark, folder))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- replies -----------------------------------------------------------------------------------


@area.query(
    "e5_judge_replies",
    duck.with_(*JUDGED, select="SELECT id, parse_ok, CASE WHEN parse_ok THEN 'because' END AS reason FROM judged"),
)
def _e5(spark, folder):
    reply = J.reply_json(F.col("raw"))
    rows = inputs.judge_replies(spark, folder).select("id", reply.alias("j"))
    return rows.select("id", F.col("j").isNotNull().alias("parse_ok"), F.get_json_object("j", "$.reason").alias("reason"))


@area.query("e6_verdicts", duck.with_(*JUDGED, select="SELECT id, parse_ok, winner_ab, winner_model FROM judged"))
def _e6(spark, folder):
    return _judged(spark, folder).select("id", "parse_ok", "winner_ab", "winner_model")


@area.query(
    "e7_fact_scores",
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN (turn % 6)::double END AS s, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS r FROM conversations),
    raws AS (SELECT *, '{{"score":"' || coalesce(cast(cast(s AS bigint) AS varchar), 'n/a') || '"}}' AS raw FROM c)
    SELECT conv_id, turn, s AS fact_score, s / 5.0 AS fact_consistency, left({duck.collapse("CASE WHEN r <> '' THEN r ELSE raw END")}, 240) AS fact_reason FROM raws""",
)
def _e7(spark, folder):
    score = F.when(F.col("turn") % 3 > 0, (F.col("turn") % 6).cast("string")).otherwise("n/a")
    reason = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    rows = read_table(spark, folder, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct(score.alias("score"), reason.alias("reason"))).alias("reply"), F.to_json(F.struct(score.alias("score"))).alias("raw")
    )
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in J.fact_fields(F.col("reply"), F.col("raw")).items()])


@area.query(
    "e4_entailment",
    f"""WITH c AS (SELECT event_id, user_id, {duck.hash_mod(1000, _q('e'), 'event_id')} / 1000.0::double AS e, {duck.hash_mod(1000, _q('c'), 'event_id')} / 1000.0::double AS c,
        event_id % 5 = 0 AS none FROM events)
    SELECT user_id, round(avg(CASE WHEN none THEN 0.0::double ELSE greatest(e, e / 2) END), 6) AS nli_entailment, round(avg(c), 6) AS nli_contradiction,
      round(avg(CASE WHEN none THEN 0.0::double ELSE e END) * (1 - avg(c)), 6) AS fact_consistency FROM c GROUP BY user_id""",
)
def _e4(spark, folder):
    e, c = (hash_mod(1000, n, F.col("event_id")) / 1000.0 for n in "ec")

    def out(label, score):
        return F.struct(label.alias("label"), score.alias("score"))

    label = F.when(F.col("event_id") % 5 == 0, "neutral").otherwise("ENTAILMENT")
    outputs = F.array(out(label, e), out(label, e / 2), out(F.lit("Contradiction"), c))
    rows = read_table(spark, folder, "events").select("user_id", outputs.alias("outputs"))
    return _rounded(E.entailment_summary(rows, ["user_id"], "outputs"), "nli_entailment", "nli_contradiction", "fact_consistency")


# ---- blinding ----------------------------------------------------------------------------------

PAIRS = (
    MESSAGES,
    "pairs AS (SELECT id, text AS question, 'a ' || text AS base, 'b ' || right(text, length(text) // 2) AS dpo FROM msgs)",
    f"""blind AS (SELECT id, question, CASE WHEN h THEN base ELSE dpo END AS A, CASE WHEN h THEN dpo ELSE base END AS B, h
      FROM (SELECT *, {duck.hash_mod(2, _q('42'), 'id')} = 0 AS h FROM pairs))""",
)


@area.query(
    "a1_blind_assignment",
    duck.with_(*PAIRS, select="SELECT id, question, A, B, CASE WHEN h THEN 'base' ELSE 'dpo' END AS key_a FROM blind"),
)
def _a1(spark, folder):
    shown, key = stats.blind(inputs.blind_pairs(spark, folder), 42)
    return shown.join(key.select("id", F.col("A").alias("key_a")), "id")


_REFS = f"""refs AS (SELECT CASE WHEN turn % 2 = 0 THEN id END AS id, CASE WHEN turn % 3 = 0 THEN text END AS question, role || ' ' || turn AS reference, id AS position FROM msgs),
    by_id AS (SELECT id, arg_max(reference, position) AS r FROM refs WHERE id IS NOT NULL GROUP BY id),
    by_q AS (SELECT {duck.collapse('question')} AS question, arg_max(reference, position) AS r FROM refs WHERE question IS NOT NULL GROUP BY 1)"""


@area.query(
    "a2_unblind",
    duck.with_(
        *PAIRS, _REFS, f"u AS (SELECT id, {duck.collapse('question')} AS question, {duck.collapse('base')} AS base_answer, {duck.collapse('dpo')} AS dpo_answer FROM pairs)",
        select="SELECT u.id, u.question, base_answer, dpo_answer, coalesce(i.r, q.r, '') AS reference FROM u LEFT JOIN by_id i ON i.id = u.id LEFT JOIN by_q q ON q.question = u.question",
    ),
)
def _a2(spark, folder):
    return _unblinded(spark, folder)


def _unblinded(spark, folder):
    shown, key = stats.blind(inputs.blind_pairs(spark, folder), 42)
    key = key.select("id", F.upper("A").alias("A"), F.concat(F.lit(" "), F.col("B")).alias("B"), F.col("id").alias("position"))
    turn, ident = F.col("turn"), F.col("conv_id") * inputs.TURNS + F.col("turn")
    refs = read_table(spark, folder, "conversations").select(
        F.when(turn % 2 == 0, ident).alias("id"),
        F.when(turn % 3 == 0, F.col("text")).alias("question"),
        F.concat_ws(" ", "role", turn.cast("string")).alias("reference"),
        ident.alias("position"),
    )
    return stats.unblind(shown, key, refs)


@area.query("a3_model_scores", duck.with_(*JUDGED, select="SELECT id, model, metric, value FROM scores"))
def _a3(spark, folder):
    return _scores(spark, folder)


@area.query("a4_unjudged", duck.with_(*PAIRS, select="SELECT id, question FROM blind WHERE id NOT IN (SELECT event_id FROM events) "))
def _a4(spark, folder):
    shown, _ = stats.blind(inputs.blind_pairs(spark, folder), 42)
    done = read_table(spark, folder, "events").select(F.col("event_id").alias("id"))
    return stats.unjudged(shown, done).select("id", "question")


_WINS = """SELECT count(*) AS total_rows, count(*) FILTER (WHERE parse_ok) AS valid_rows, count(*) FILTER (WHERE NOT parse_ok) AS invalid_rows,
  count(*) FILTER (WHERE winner_model = 'base') AS base_wins, count(*) FILTER (WHERE winner_model = 'dpo') AS dpo_wins, count(*) FILTER (WHERE winner_model = 'tie') AS tie_wins,
  round(count(*) FILTER (WHERE winner_model = 'dpo') / greatest(1, count(*) FILTER (WHERE winner_model IN ('base', 'dpo'))), 6) AS dpo_win_rate_excl_tie,
  round(count(*) FILTER (WHERE winner_model = 'dpo') / count(*), 6) AS dpo_win_rate_incl_tie FROM judged"""


@area.query("a5_win_counts", duck.with_(*JUDGED, select=_WINS))
def _a5(spark, folder):
    return _rounded(stats.win_counts(_judged(spark, folder)), "dpo_win_rate_excl_tie", "dpo_win_rate_incl_tie")


_MEANS = """SELECT metric, round(avg(value) FILTER (WHERE model = 'base'), 6) AS base_mean, round(avg(value) FILTER (WHERE model = 'dpo'), 6) AS dpo_mean,
  round(avg(value) FILTER (WHERE model = 'dpo') - avg(value) FILTER (WHERE model = 'base'), 6) AS delta FROM scores GROUP BY metric"""


@area.query("a5_judge_means", duck.with_(*JUDGED, select=_MEANS))
def _a5_means(spark, folder):
    return _rounded(stats.metric_means(_scores(spark, folder)), "base_mean", "dpo_mean", "delta")


_sim_texts = """texts AS (SELECT DISTINCT md5(t) AS id, t AS text FROM (SELECT unnest([question, base_answer, dpo_answer, reference]) AS t FROM rows_) WHERE t <> '')"""
_HASHED = (
    f"words AS (SELECT id, unnest({duck.tokens('text')}) AS w FROM texts)",
    "slots AS (SELECT id, cast('0x' || substr(md5(w), 1, 8) AS bigint) % 64 AS dim, sum(1 - 2 * (cast('0x' || substr(md5(w), 9, 8) AS bigint) % 2)) AS v FROM words GROUP BY ALL)",
    "norms AS (SELECT id, sqrt(sum(v * v)::double) AS m FROM slots GROUP BY id)",
    "hashed AS (SELECT id, dim, cast(cast(v / m AS float) AS double) AS v FROM slots JOIN norms USING (id) WHERE m > 0)",
)


_SIM_ROWS = f"rows_ AS (SELECT u.id, u.question, base_answer, dpo_answer, coalesce(i.r, q.r, '') AS reference FROM (SELECT id, {duck.collapse('question')} AS question, {duck.collapse('base')} AS base_answer, {duck.collapse('dpo')} AS dpo_answer FROM pairs) u LEFT JOIN by_id i ON i.id = u.id LEFT JOIN by_q q ON q.question = u.question)"


def _dense_vectors() -> tuple[str, ...]:
    """Dense lists per text, so a similarity is one list product per row."""
    return (
        "grid AS (SELECT t.id, d.dim FROM texts t, (SELECT unnest(range(64)) AS dim) d)",
        "vecs AS (SELECT g.id, list(coalesce(h.v, 0.0::double) ORDER BY g.dim) AS v FROM grid g LEFT JOIN hashed h ON h.id = g.id AND h.dim = g.dim GROUP BY g.id)",
    )


def _cos(a: str, b: str) -> str:
    d = f"list_inner_product({a}.v, {b}.v)"
    m = f"(sqrt(list_inner_product({a}.v, {a}.v)) * sqrt(list_inner_product({b}.v, {b}.v)))"
    return f"CASE WHEN {a}.v IS NULL OR {b}.v IS NULL THEN NULL WHEN {m} = 0 THEN 0.0::double ELSE {d} / {m} END"


_VECTOR = {"question": "qv", "base_answer": "bv", "dpo_answer": "dv", "reference": "rv"}
_SIMS = (
    *PAIRS, _REFS, _SIM_ROWS, _sim_texts, *_HASHED, *_dense_vectors(),
    "sims AS (SELECT r.id, " + ", ".join(f"{_cos(_VECTOR[a], _VECTOR[b])} AS {n}" for n, a, b in stats.SIMILARITIES) + " FROM rows_ r "
    + " ".join(f"LEFT JOIN vecs {v} ON {v}.id = md5(r.{c}) AND r.{c} <> ''" for c, v in _VECTOR.items()) + ")",
)


@area.query(
    "a6_similarities",
    duck.with_(*_SIMS, select="SELECT id, " + ", ".join(f"round({n}, 6) AS {n}" for n, _, _ in stats.SIMILARITIES) + " FROM sims"),
)
def _a6(spark, folder):
    return _rounded(stats.similarities(_unblinded(spark, folder)), *[n for n, _, _ in stats.SIMILARITIES])


@area.query(
    "a7_metric_means",
    """WITH s AS (SELECT event_type AS metric, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'dpo' END AS model, CASE WHEN event_id % 11 < 2 THEN NULL ELSE value END AS value FROM events)
    SELECT metric, round(avg(value) FILTER (WHERE model = 'base'), 6) AS base_mean, round(avg(value) FILTER (WHERE model = 'dpo'), 6) AS dpo_mean,
      round(avg(value) FILTER (WHERE model = 'dpo') - avg(value) FILTER (WHERE model = 'base'), 6) AS delta FROM s GROUP BY metric""",
)
def _a7(spark, folder):
    value = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 11 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = read_table(spark, folder, "events").select(
        F.col("event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, "base").otherwise("dpo").alias("model"), value.alias("value")
    )
    return _rounded(stats.metric_means(rows), "base_mean", "dpo_mean", "delta")


# ---- paired statistics -------------------------------------------------------------------------


def _pairs(spark, folder):
    return stats.paired(_scores(spark, folder))


@area.query(
    "a8_paired_means",
    duck.with_(*JUDGED, select="SELECT metric, count(*) AS n, round(avg(base), 6) AS base_mean, round(avg(dpo), 6) AS dpo_mean, round(avg(diff), 6) AS mean_diff FROM diffs GROUP BY metric"),
)
def _a8(spark, folder):
    return _rounded(stats.paired_means(_pairs(spark, folder)), "base_mean", "dpo_mean", "mean_diff")


@area.query("a9_bootstrap_ci")
def _a9(spark, folder):
    return _rounded(stats.bootstrap_ci(_pairs(spark, folder)), "ci_low", "ci_high")


@area.query(
    "a9_bootstrap_against_normal",
    duck.with_(*JUDGED, select="SELECT metric, count(*) AS n, round(avg(diff), 6) AS mean_diff, true AS low_agrees, true AS high_agrees FROM diffs GROUP BY metric"),
)
def _a9_check(spark, folder):
    """The interval lies where the normal approximation puts it, up to a quarter of a standard error."""
    pairs = _pairs(spark, folder)
    sums = pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), (F.stddev_samp("diff") / F.sqrt(F.count("*"))).alias("se")
    )
    both = sums.join(stats.bootstrap_ci(pairs), "metric")

    def near(end, sign):
        return F.abs(F.col(end) - (F.col("mean_diff") + sign * 1.96 * F.col("se"))) < 0.25 * F.col("se")

    return both.select("metric", "n", F.round("mean_diff", 6).alias("mean_diff"), near("ci_low", -1).alias("low_agrees"), near("ci_high", 1).alias("high_agrees"))


@area.query(
    "a10_linear_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.025), 6) AS p2_5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.975), 6) AS p97_5
    FROM events GROUP BY event_type""",
)
def _a10(spark, folder):
    probs = {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}
    return _rounded(spread.quantiles(read_table(spark, folder, "events"), ["event_type"], "value", probs), *probs)


_W = " ".join(f"WHEN '{m}' THEN {w}::double" for m, w in J.WEIGHTS.items())
WEIGHTED = f"""weighed AS (SELECT id, model, value, CASE metric {_W} END AS w FROM scores WHERE value IS NOT NULL),
    weighted AS (SELECT id, model, 'weighted' AS metric, round(sum(w * value) / sum(w), 12) AS value FROM weighed WHERE w IS NOT NULL GROUP BY id, model)"""


@area.query("a11_weighted_scores", duck.with_(*JUDGED, WEIGHTED, select="SELECT id, model, round(value, 6) AS value FROM weighted"))
def _a11(spark, folder):
    return _rounded(stats.weighted_scores(_scores(spark, folder)), "value").drop("metric")


_RANKED = """ranked AS (SELECT metric, diff, abs(diff) AS s, rank() OVER (PARTITION BY metric ORDER BY abs(diff)) AS rk, count(*) OVER (PARTITION BY metric, abs(diff)) AS c FROM diffs WHERE diff <> 0),
    sums AS (SELECT metric, count(*) AS n, sum(CASE WHEN diff > 0 THEN rk + (c - 1) / 2 ELSE 0.0::double END) AS up, sum(CASE WHEN diff < 0 THEN rk + (c - 1) / 2 ELSE 0.0::double END) AS down,
      sum(c * c - 1)::double AS ties FROM ranked GROUP BY metric),
    tees AS (SELECT metric, count(*) AS pairs, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM diffs GROUP BY metric)"""


@area.query(
    "a12_signed_rank",
    duck.with_(
        *JUDGED, _RANKED,
        select="""SELECT s.metric, pairs, n, round(least(up, down), 6) AS w,
          round((least(up, down) - n * (n + 1) / 4) / sqrt((n::double * (n + 1) * (2 * n + 1) - ties / 2) / 24), 6) AS z, round(t, 6) AS t FROM sums s JOIN tees USING (metric)""",
    ),
)
def _a12(spark, folder):
    pairs = _pairs(spark, folder)
    tests = stats.signed_rank(pairs).join(stats.paired_t(pairs), "metric")
    return _rounded(tests.select("metric", "pairs", "n", "w", "z", "t"), "w", "z", "t")


@area.query("a12_significance")
def _a12_p(spark, folder):
    return stats.significance(_pairs(spark, folder).unionByName(stats.paired(stats.weighted_scores(_scores(spark, folder)))))


@area.query(
    "a13_risk_rates",
    duck.with_(
        *JUDGED,
        select="""SELECT metric, model, count(*) FILTER (WHERE value < 4) AS low, round(count(*) FILTER (WHERE value < 4) / (SELECT count(*) FROM judged), 6) AS rate
          FROM scores WHERE metric IN ('factual_consistency', 'safety') GROUP BY metric, model""",
    ),
)
def _a13(spark, folder):
    judged = _judged(spark, folder)
    return _rounded(stats.risk_rates(stats.model_scores(judged), judged.agg(F.count("*")).scalar()), "rate")


@area.query(
    "a14_winner_rates",
    duck.with_(*JUDGED, select="SELECT coalesce(winner_model, 'invalid') AS outcome, count(*) AS rows, round(count(*) / (SELECT count(*) FROM judged), 6) AS share FROM judged GROUP BY 1"),
)
def _a14(spark, folder):
    return _rounded(stats.winner_rates(_judged(spark, folder)), "share")


_lp = "-({}::double / 100)"


@area.query(
    "a15_preference_margins",
    duck.with_(
        MESSAGES,
        f"lp AS (SELECT {_lp.format(duck.hash_mod(900, _q('chosen'), 'id'))} - {_lp.format(duck.hash_mod(1000, _q('rejected'), 'id'))} AS m FROM msgs)",
        select="SELECT count(*) AS n, round(count(*) FILTER (WHERE m > 0) / count(*), 6) AS accuracy, round(avg(m), 6) AS mean_margin, round(stddev_pop(m), 6) AS std_margin FROM lp",
    ),
)
def _a15(spark, folder):
    rows = inputs.messages(spark, folder).select(
        (-hash_mod(900, "chosen", F.col("id")) / 100).alias("chosen_logprob"), (-hash_mod(1000, "rejected", F.col("id")) / 100).alias("rejected_logprob")
    )
    return _rounded(stats.preference_margins(rows), "accuracy", "mean_margin", "std_margin")


def _at(q: float) -> str:
    return f"max(value) FILTER (WHERE rn = round_even((n - 1) * {q}::double, 0)::bigint + 1)"


@area.query(
    "a16_stage_profile",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type AS stage, count(*) AS count, round(avg(value), 6) AS avg, {_at(0.5)} AS p50, {_at(0.9)} AS p90, max(value) AS max, round(sum(value), 6) AS sum,
      round(sum(value) / (SELECT sum(value) FROM events) * 100, 6) AS share FROM r GROUP BY event_type""",
)
def _a16(spark, folder):
    times = read_table(spark, folder, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return _rounded(stats.stage_profile(times), "avg", "sum", "share")


@area.query("a16_slow_samples", "SELECT event_id AS sample, event_type AS stage, value AS seconds FROM events ORDER BY value DESC, event_id LIMIT 5")
def _a16_slow(spark, folder):
    times = read_table(spark, folder, "events").select(F.col("event_id").alias("sample"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return stats.slow_samples(times, 5)
