"""Mixing to target weights with soft membership.

1. Every document gets a few dense features, all DataFrame expressions over its whole text.
2. The labelled rows give each domain (``good``, ``low``, ``toxic``) a prior and, for each feature, a
   mean and a variance; a Gaussian naive Bayes expression turns features into posteriors.
3. Document rates x >= 0 minimise  sum_k ((sum_d x_d tokens_d p_dk - target_k) / T)^2 / m_k
   + RIDGE sum_d tokens_d / T (x_d - 1)^2  by projected gradient: T is the corpus' tokens, m_k the
   domain's share of them. In the norm that weights documents by their tokens the step 1 / (1 + RIDGE)
   is safe, and one step is x <- max(0, (1 - s RIDGE) x + s RIDGE - s sum_k p_k r_k / m_k), where r
   are the K residuals. So x after any number of steps is an expression of the document's own
   posteriors: nothing per document is kept or shuffled.
4. As x depends on posteriors alone, the first steps are taken on a summary: documents added up by
   posteriors, in CELLS equal parts of each axis, a table whose rows have a bound whatever the corpus.
   The steps then go on over the documents themselves until every domain's exact residual is at most
   CLOSE, so the summary only saves passes and decides nothing. Each step is one aggregate of K sums.
5. Rows are stored once with their features, so a text is read once, and the steps, the rates and the
   drawing of copies read stored numbers. Steps and posteriors are bound once a row (see ``rate``).

Domains without labelled rows have posterior 0, and their target goes to the others in proportion.

Defined results: a null or empty text has no tokens, the prior as posterior and rate 1 at first (its
rate changes like others', it just has no weight); repeated rows are rows like others; ids may be
null; without any labelled row the rates are 1; an empty table gives an empty table; other columns of
the input are not read (``mixed`` returns them).
"""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.session import cut, stored

TARGETS = {"good": 0.85, "low": 0.1, "toxic": 0.05}
RIDGE = 1e-3
#: Steps on the summary, and on the documents, at most; ``solved`` warns if a target is then still missed.
STEPS = 60
#: Largest share of the corpus' tokens by which a domain may miss its target when the steps end.
CLOSE = 5e-4
#: Parts of each posterior's axis; three domains have at most CELLS^2 cells.
CELLS = 128
#: Tasks that an iteration reads the cells with.
CELL_TASKS = 4
LEAST_VARIANCE = 1e-3
#: Common insults that one feature looks for.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
FEATURES = ("f_length", "f_word", "f_symbol", "f_shout", "f_lines", "f_insult")


def featured(docs: DataFrame) -> DataFrame:
    """Each row as ``row``, with doc_id, a fraction in [0, 1) drawn from the row, tokens and the features of its text."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    fraction = F.xxhash64(F.lit(11), "row.doc_id", text).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    return held.select("row", F.col("row.doc_id").alias("doc_id"), fraction.alias("fraction"), *measures(text))


def measures(text: Column) -> list[Column]:
    size = F.greatest(F.octet_length(text), F.lit(1)).cast("double")
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    less = lambda chars: F.octet_length(F.translate(text, chars, ""))
    lines = F.split(text, "\n")
    low = F.lower(text)
    insults = F.lit(0.0)
    for w in INSULTS:
        insults = insults + F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0)
    return [
        tokens.alias("tokens"),
        F.log1p(tokens.cast("double")).alias("f_length"),
        F.log1p(size / F.greatest(tokens, F.lit(1))).alias("f_word"),
        F.log1p((1 - less("#*$%&|<>") / size) * 100).alias("f_symbol"),
        F.log1p((1 - less("!?") / size) * 100).alias("f_shout"),
        (F.size(F.array_distinct(lines)) / F.size(lines).cast("double")).alias("f_lines"),
        F.log1p(insults).alias("f_insult"),
    ]


def domain(labels: DataFrame) -> DataFrame:
    """doc_id and domain of each labelled row with both marks."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low")
    return labels.where("toxic is not null and quality is not null").select(F.col("doc_id").alias("labelled"), name.alias("domain"))


def fitted(features: DataFrame, labels: DataFrame) -> dict[str, dict]:
    """Share, and mean and variance of each feature, by domain; at most three rows reach the driver."""
    rows = features.join(domain(labels), F.col("doc_id") == F.col("labelled"))
    stats = rows.groupBy("domain").agg(F.count("*").alias("n"), *(g(f).alias(f"{k}_{f}") for f in FEATURES for k, g in (("mean", F.avg), ("var", F.var_pop))))
    found = {r["domain"]: r.asDict() for r in stats.collect()}
    total = sum(r["n"] for r in found.values())
    return {k: {"share": r["n"] / total, **{f: (r[f"mean_{f}"], max(r[f"var_{f}"], LEAST_VARIANCE)) for f in FEATURES}} for k, r in sorted(found.items())}


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: as the element of a one-element array. The optimizer would
    otherwise put the whole expression wherever ``use`` names it, and inside a fold at each of its steps."""
    return F.transform(F.array(value), use)[0]


def posteriors(model: dict[str, dict]) -> Column:
    """The posteriors of all domains, a struct, as an expression of the features."""
    logs = {}
    for k, m in model.items():
        term = F.lit(math.log(m["share"]))
        for f in FEATURES:
            mean, var = m[f]
            term = term - (F.col(f) - mean) * (F.col(f) - mean) / (2 * var) - 0.5 * math.log(var)
        logs[k] = term

    def shares(v: Column) -> Column:
        return F.struct(*((1 / sum((F.exp(v[j] - v[k]) for j in model if j != k), F.lit(1.0))).alias(k) for k in model))

    return bound(F.struct(*(v.alias(k) for k, v in logs.items())), shares)


def rate(pulls: list[dict[str, float]]) -> Column:
    """The rate after all steps from 1; ``pulls`` is step * residual / share of each domain, by step.

    The steps are data that one fold reads, so the plan and its code stay the same however many there are.
    """
    if not pulls:
        return F.lit(1.0)
    names, s = list(pulls[0]), 1 / (1 + RIDGE)
    steps = F.from_json(F.lit(json.dumps([[p[k] for k in names] for p in pulls])), "array<array<double>>")

    def folded(p: Column) -> Column:
        def step(x: Column, pull: Column) -> Column:
            move = F.lit(s * RIDGE)
            for i, k in enumerate(names):
                move = move - p[k] * pull[i]
            return F.greatest(F.lit(0.0), x * (1 - s * RIDGE) + move)

        return F.aggregate(steps, F.lit(1.0), step)

    return bound(F.struct(*(F.col(f"p_{k}").alias(k) for k in names)), folded)


def cells(members: DataFrame, names: list[str]) -> DataFrame:
    """Tokens (``weight``) and mean posteriors by tokens (``p_*``) of all documents whose posteriors share a cell."""
    weight = F.col("tokens").cast("double")
    place = [F.floor(F.least(F.col(f"p_{k}"), F.lit(1.0)) * CELLS).alias(f"at_{k}") for k in names]
    sums = members.where("tokens > 0").groupBy(*place).agg(F.sum(weight).alias("weight"), *(F.sum(weight * F.col(f"p_{k}")).alias(f"s_{k}") for k in names))
    return cut(sums.select("weight", *((F.col(f"s_{k}") / F.col("weight")).alias(f"p_{k}") for k in names)).coalesce(CELL_TASKS))


def reached(rows: DataFrame, weight: Column, names: list[str], pulls: list[dict[str, float]]) -> dict[str, float]:
    """``_total`` weight of ``rows`` and each domain's expected weight at the rates after ``pulls``."""
    held = rows.select(weight.alias("weight"), *(f"p_{k}" for k in names), rate(pulls).alias("x"))
    return held.agg(F.sum("weight").alias("_total"), *(F.sum(F.col("x") * F.col("weight") * F.col(f"p_{k}")).alias(k) for k in names)).first().asDict()


def solved(members: DataFrame, names: list[str], targets: dict[str, float]) -> tuple[list[dict[str, float]], dict[str, float]]:
    """The pulls of all steps for rows with ``tokens`` and posteriors ``p_*``, and each domain's residual over the rows themselves."""
    every, tokens = members.where("tokens > 0"), F.col("tokens").cast("double")
    start = reached(every, tokens, names, [])
    total = start["_total"] or 0.0
    if not total:
        return [], {}
    share = {k: max(start[k] / total, 1e-9) for k in names}
    wanted = sum(targets.get(k, 0.0) for k in names) or 1.0
    goal = {k: targets.get(k, 0.0) / wanted for k in names}
    pulls: list[dict[str, float]] = []

    def descend(rows: DataFrame, weight: Column, close: float) -> dict[str, float]:
        for left in range(STEPS, -1, -1):
            now = reached(rows, weight, names, pulls)
            residual = {k: now[k] / total - goal[k] for k in names}
            if not left or max(abs(r) for r in residual.values()) <= close:
                return residual
            pulls.append({k: residual[k] / share[k] / (1 + RIDGE) for k in names})

    descend(cells(members, names), F.col("weight"), CLOSE / 2)
    residual = descend(every, tokens, CLOSE)
    if max(abs(r) for r in residual.values()) > CLOSE:
        warnings.warn(f"mixing ended with residuals {residual}", stacklevel=2)
    return pulls, residual


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[DataFrame, list, dict[str, float], list[str]]:
    """The stored rows with their posteriors, the pulls of all steps, the residuals, and the domains that have labelled rows."""
    features = stored(featured(docs))
    model = fitted(features, labels)
    if not model:
        return features, [], {}, []
    scored = features.select("row", "doc_id", "fraction", "tokens", posteriors(model).alias("p"))
    members = scored.select("row", "doc_id", "fraction", "tokens", *(F.col("p")[k].alias(f"p_{k}") for k in model))
    pulls, residual = solved(members, list(model), targets)
    return members, pulls, residual, list(model)


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """How far each domain's share of the tokens is from its target at the fitted rates, over all documents: domain, residual and steps."""
    _, pulls, residual, _ = fit(docs, labels, targets)
    return docs.sparkSession.createDataFrame([(k, v, len(pulls)) for k, v in residual.items()], "domain string, residual double, steps int")


def copies(rate_: Column) -> Column:
    """A whole number of copies with that expectation."""
    return (F.floor(rate_) + F.when(F.col("fraction") < rate_ - F.floor(rate_), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Per document: doc_id, tokens, posteriors, rate and whole copies."""
    members, pulls, _, names = fit(docs, labels, targets)
    known = [F.col(f"p_{k}") if k in names else F.lit(0.0).alias(f"p_{k}") for k in TARGETS]
    out = members.select("doc_id", "tokens", "fraction", *known).withColumn("rate", rate(pulls))
    return out.withColumn("copies", copies(F.col("rate"))).drop("fraction")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as its rate says. Rates are expressions of a stored row, so no text is shuffled."""
    members, pulls, _, _ = fit(docs, labels, targets)
    times = members.withColumn("n", copies(rate(pulls))).where("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
