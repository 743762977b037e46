"""Mixing a corpus to target token weights per domain, with soft membership.

A naive Bayes table learned from labelled documents gives every document a posterior over
the domains. Document rates r >= ``least_rate`` are then fitted so that the expected token
totals E_d = sum_i r_i t_i p_id meet the targets T_d: projected gradient descent on
sum_d (E_d - T_d)^2 / S_d, where S_d is the corpus' own total of the domain. With a step
of one over the token count (the gradient's common factor t_i) the update of a document is
r <- max(least_rate, r - sum_d p_d (E_d - T_d) / S_d), which depends on its posterior only
and is stable because the preconditioned matrix has no eigenvalue above one. Documents of
about equal posterior move together: they are summed into cells, with their mean posterior by tokens, before
the iterations; each iteration is one distributed sum over the cells that brings D numbers
to the driver, and a document's rate is the fold of those D numbers over its own posterior,
which is not rounded. The steps end when the totals meet the targets or stand still, which they do
where the targets are beyond what nonnegative rates can reach; ``target_gaps`` says what
was reached, over all documents.

The classifier is fitted on a sample of at most ``most_labelled`` labelled documents and has
``words_per_domain`` words for each domain of the sample. All documents are
scored and counted, over their whole texts. Native expressions only.

Defined results: a null text has no words, the prior as posterior and a rate like any
other; domains without labelled documents or without tokens take no target and the other
weights are scaled up; an unlabelled corpus (no labels or no documents) keeps rate 1;
repeated rows each have their rate; extra columns stay inside ``doc``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import let
from passagemill.llm.common import stored
from passagemill.llm.quality import listed_counts, words_of

MOST_LABELLED, WORDS_PER_DOMAIN = 20_000, 24
EVIDENCE = 40.0  # words that count fully; longer texts keep their averages, since words are not independent
CLOSE, STILL = 1e-4, 1e-4  # steps end when all totals are this close to the targets, or none moves by more than the second share
CELLS = 500  # posteriors in one cell are equal when rounded to this part


def sum_of(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


class DomainTable:
    """Naive Bayes as a table: ``logs[d][v]`` for domain d and word v, the last v standing for all other words."""

    def __init__(self, domains: list[str], words: list[str], logs: list[list[float]], priors: list[float]) -> None:
        self.domains, self.words, self.logs, self.priors = domains, words, logs, priors

    def posterior(self, words: Column, evidence: float = EVIDENCE) -> Column:
        """Posterior over ``domains`` of an array of words."""

        def scored(c: Column) -> Column:
            n = F.size(words).cast("double")
            rest = n - sum_of(c)
            scale = F.least(F.lit(1.0), F.lit(evidence) / F.greatest(n, F.lit(1.0)))
            # The table is one constant, not an expression for each of its numbers.
            table = F.from_json(F.lit(json.dumps([[prior, *row] for prior, row in zip(self.priors, self.logs)])), "array<array<double>>")
            one = lambda counts: F.transform(table, lambda row: sum_of(F.zip_with(counts, row, lambda a, b: a * b)))
            weighted = F.concat(F.array(F.lit(1.0)), F.transform(F.concat(c, F.array(rest)), lambda x: x * scale))
            return let(let(weighted, one), softmax)

        def softmax(s: Column) -> Column:
            raised = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
            return let(raised, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

        return let(listed_counts(words, self.words), scored)


def learned(
    docs: DataFrame, labelled_ids: DataFrame, domain: str = "lang", most_labelled: int = MOST_LABELLED, words_per_domain: int = WORDS_PER_DOMAIN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DomainTable | None:
    """The table from at most ``most_labelled`` documents whose ids are in ``labelled_ids``, labelled by ``domain``."""
    picked = labelled_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(domain).cast("string").alias("domain"), F.lower(F.col(text_col)).alias("text"))
    rows = rows.where("domain is not null and text is not null").join(F.broadcast(picked), "id")  # at most `most_labelled` ids
    counts = stored(
        rows.select("domain", F.explode(words_of(F.col("text"))).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n")), "labelled-words"
    )
    totals = counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()  # domains of the sample
    domains = sorted(r["domain"] for r in totals)
    if not domains:
        return None
    best = Window.partitionBy("domain").orderBy(F.desc("n"), "word")
    often = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= words_per_domain)
    words = sorted({r["word"] for r in often.select("word").collect()})
    found = {(r["domain"], r["word"]): r["n"] for r in counts.where(F.col("word").isin(words)).collect()}
    total = {r["domain"]: r["n"] for r in totals}
    logs = []
    for d in domains:
        n = [found.get((d, w), 0) + 0.5 for w in words]
        n.append(max(0.5, total[d] - sum(n)))
        logs.append([math.log(x / sum(n)) for x in n])
    everything = sum(total.values())
    return DomainTable(domains, words, logs, [math.log(total[d] / everything) for d in domains])


def rate_of(posterior: Column, steps: list[list[float]], least_rate: float) -> Column:
    """The rate after the given gradient steps; each step is the vector (E_d - T_d) / S_d."""
    if not steps:
        return F.lit(1.0)
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def move(r: Column, step: Column) -> Column:
        down = F.aggregate(F.zip_with(posterior, step, lambda p, s: p * s), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(float(least_rate)), r - down)

    return F.aggregate(taken, F.lit(1.0), move)


def fitted_steps(cells: DataFrame, domains: list[str], weights: dict[str, float], least_rate: float, keep_all: bool) -> list[list[float]]:
    """Gradient steps until the totals are met; ``cells`` holds ``posterior, tokens``.

    With ``keep_all`` the total is the smallest for which no domain has to shrink, else the corpus' own.
    """
    size = len(domains)

    def totals(steps: list[list[float]]) -> list[float]:
        weight = F.col("tokens") * rate_of(F.col("posterior"), steps, least_rate)
        row = cells.agg(*[F.sum(F.get("posterior", F.lit(d)) * weight).alias(f"e{d}") for d in range(size)]).first()
        return [float(x or 0.0) for x in row]

    own = totals([])
    used = [d for d in range(size) if own[d] > 0 and weights.get(domains[d], 0.0) > 0]
    if not used:
        return []
    share = sum(weights[domains[d]] for d in used)
    wanted = {d: weights[domains[d]] / share for d in used}
    total = max(own[d] / wanted[d] for d in used) if keep_all else sum(own[d] for d in used)
    steps, now, moved = [], own, total
    while moved > STILL * total:
        gap = {d: now[d] - wanted[d] * total for d in used}
        if max(map(abs, gap.values())) <= CLOSE * total:
            break
        steps.append([gap[d] / own[d] if d in gap else 0.0 for d in range(size)])
        before, now = now, totals(steps)
        moved = max(abs(x - y) for x, y in zip(before, now))
    return steps


def posterior_cells(rows: DataFrame, size: int) -> DataFrame:
    """``posterior, tokens``: documents of about equal posterior summed, with the mean of their posteriors by tokens."""
    tokens = F.sum("n_tokens")
    mean = F.array(*[F.sum(F.get("posterior", F.lit(d)) * F.col("n_tokens")) / tokens for d in range(size)])
    near = F.transform("posterior", lambda p: F.round(p * CELLS).cast("int")).alias("near")
    return rows.where("n_tokens > 0").groupBy(near).agg(mean.alias("posterior"), tokens.alias("tokens"))


def target_gaps(mixed_rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``domain, wanted, reached``: the share of the expected tokens that each target asks for and got, over all documents."""
    each = mixed_rows.select("n_tokens", "rate", F.explode("posterior").alias("domain", "p"))
    got = each.groupBy("domain").agg(F.sum(F.col("p") * F.col("rate") * F.col("n_tokens")).alias("reached"))
    asked = got.join(got.sparkSession.createDataFrame(sorted(weights.items()), "domain string, wanted double"), "domain")
    sums = asked.agg(F.sum("wanted").alias("all_wanted"), F.sum("reached").alias("all_reached"))  # one row
    return asked.crossJoin(sums).select("domain", (F.col("wanted") / F.col("all_wanted")).alias("wanted"), (F.col("reached") / F.col("all_reached")).alias("reached"))


def mixed(
    docs: DataFrame, labelled_ids: DataFrame, weights: dict[str, float], domain: str = "lang", least_rate: float = 0.0, keep_all: bool = False,
    id_col: str = "doc_id", text_col: str = "text", seed: int = 0, columns: list[str] | None = None,
) -> DataFrame:
    """``doc, n_tokens, posterior`` (map by domain), ``rate, copies``; ``doc`` has the given ``columns``, or all.

    Documents are scored once and stored with their posteriors, which the sums then read alone.
    ``copies`` is the rate rounded up or down by a hash of the id and the text, so that its expectation is the rate.
    """
    table = learned(docs, labelled_ids, domain, id_col=id_col, text_col=text_col)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1_000_003)) / 1_000_003.0
    words = words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(columns or docs.columns)).alias("doc"), draw.alias("draw"), words.alias("words"))
    domains = table.domains if table else []
    posterior = table.posterior(F.col("words")) if table else F.array().cast("array<double>")
    rows = stored(rows.select("doc", "draw", F.size("words").cast("long").alias("n_tokens"), posterior.alias("posterior")), "posteriors")
    steps: list[list[float]] = []
    if table:
        cells = stored(posterior_cells(rows, len(domains)), "posterior-cells")
        steps = fitted_steps(cells, domains, weights, least_rate, keep_all)
    rows = rows.withColumn("rate", rate_of(F.col("posterior"), steps, least_rate))
    copies = F.floor(F.col("rate")) + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    names = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    return rows.select("doc", "n_tokens", F.map_from_arrays(names, F.col("posterior")).alias("posterior"), "rate", copies.cast("long").alias("copies"))


#: Shares of tokens by language that the pipeline mixes to; no document is lost, scarcer languages repeat.
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def produced(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``mixed`` with the production parameters."""
    return mixed(docs, labels, TARGETS, least_rate=1.0, keep_all=True, columns=columns)


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document as often as its ``copies`` say; all columns as they came."""
    return produced(docs, labels).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")
