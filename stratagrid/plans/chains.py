"""Named chains of steps: each step takes and returns a DataFrame, fitted ones carry a small model.

A step fitted on training folds only is refused on full history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.rolling import rolled
from stratagrid.operators import aggregates, series, text
from stratagrid.operators import cross_section as cs


@dataclass
class Step:
    """``apply(df, model)``; ``fit(df)`` gives the model. ``scope`` is ``any`` or ``fold_train_only``."""

    name: str
    apply: Callable[[DataFrame, object], DataFrame]
    fit: Callable[[DataFrame], object] | None = None
    scope: str = "any"


@dataclass
class Chain:
    name: str
    steps: list[Step] = field(default_factory=list)

    def run(self, df: DataFrame, train: DataFrame | None = None) -> DataFrame:
        """All steps in order, fitted on ``train``, or on ``df`` itself if they may be."""
        for s in self.steps:
            if s.scope == "fold_train_only" and train is None:
                raise ValueError(f"{s.name} is fitted on training folds only")
            df = s.apply(df, s.fit(df if train is None else train) if s.fit else None)
        return df


def plain(name: str, f: Callable[[DataFrame], DataFrame]) -> Step:
    return Step(name, lambda df, _: f(df))


def numeric(x: str, sector: str = "sector") -> Chain:
    """Outliers held, gaps filled by entity, then neutral to the sector and stretched by strength."""
    return Chain("numeric", [
        plain("outlier", lambda df: series.outlier_clip(df, x)),
        plain("missing", lambda df: series.with_imputed(df, f"{x}_clip")),
        plain("sector", lambda df: df.withColumn("neutral", cs.sector_neutral("filled", sector))),
        plain("adaptive", lambda df: rolled(df, lambda: {"strong": cs.adaptive_strength("neutral")}).drop("neutral").withColumnRenamed("strong", "neutral")),
    ])


def numeric_full(x: str, sector: str = "sector") -> Chain:
    """The numeric chain, then scaled by median and deviation, with the moments of returns beside it, both in one pass.

    Each step goes through an exchange, so columns that no later step reads end with the one that does: the result has ``neutral``, not what led to it.
    """
    outlier, missing, neutral, adaptive = numeric(x, sector).steps
    narrow = lambda name, *gone: plain(name, lambda df: df.drop(*gone))
    scaled = plain("scale", lambda df: series.robust_scale(df, "neutral", also=series.higher_order))
    return Chain("numeric_full", [outlier, narrow("clipped", x), missing, narrow("filled", f"{x}_clip", "has_gap"), neutral, narrow("levels", "filled", sector), adaptive, scaled])


def text_daily(half_life: float = 7.0) -> Chain:
    """Noise out, sentiment, decay, then one row per entity and day."""
    return Chain("text", [
        plain("quality", lambda df: df.where(~text.is_noise("text"))),
        plain("sentiment", lambda df: df.withColumn("score", text.lexicon_score("text"))),
        Step("decay", lambda df, last: df.withColumn("weight", F.pow(F.lit(0.5), F.greatest(F.date_diff(F.lit(last), "date"), F.lit(0)) / half_life)), lambda df: df.agg(F.max("date")).first()[0]),
        plain("aggregate", lambda df: text.daily_stats(df, "score", "weight")),
    ])


def text_pre(half_life: float = 7.0, edge: float = 0.2, key: str = "doc_id") -> Chain:
    """Noise and near copies out, then the side a post takes and its weight by age."""
    side = F.when(F.col("score") > edge, 1).when(F.col("score") < -edge, -1).otherwise(0)
    noise, sentiment = text_daily(half_life).steps[:2]
    copies = plain("copies", lambda df: text.without_near_copies(df, "text", key).where("kept").drop("kept"))
    return Chain("text_pre", [noise, copies, sentiment, plain("side", lambda df: df.withColumn("side", side)), text_daily(half_life).steps[2]])


def text_aggregate() -> Chain:
    """Daily statistics of scored posts, and windows of their mean."""
    return Chain("text_aggregate", [plain("daily", lambda df: text.daily_stats(df, "score")), plain("windows", lambda df: df.withColumns(series.text_windows("mean")))])


def concept(label: str, top: int = 100, least: int = 5) -> Chain:
    """Multi-hot columns over a vocabulary of the training fold."""
    return Chain("concept", [Step("vocabulary", lambda df, words: aggregates.multi_hot(df, label, words), lambda df: [r[label] for r in aggregates.vocabulary(df, label, least, top).collect()], "fold_train_only")])


def monitored(chain: Chain, df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A chain's result and the quality report of some of its columns."""
    out = chain.run(df)
    return out, aggregates.quality(out, columns)
