"""Training folds that walk backward from a lockbox, their slices of the panel, and the gates of their candidates.

Sessions are numbered from 0. A fold's outer test is ``val`` sessions; the first fold's ends ``horizon``
sessions before the lockbox, so that positions it enters are settled before that opens, and each further
fold's begins ``step`` sessions earlier. Training ends ``purge`` sessions before the outer test. Of its
targets the last 15 % are the inner validation, which picks a checkpoint. Each slice begins with ``seq``
sessions of context, and its prices run on for ``horizon`` sessions.

A plan has a row a fold and the sessions a row a date: these are the small sides. Rows of the panel join
them by date; an entity's past is added up once by stretch between training ends, not once a fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY

INNER_SHARE = 0.15
#: A path whose daily changes deviate more, or that moves by more within AHEAD sessions, is broken.
MOST_DEVIATION, MOST_MOVE, AHEAD = 0.50, 10.0, 5


@dataclass(frozen=True)
class Shape:
    """Lengths in sessions; by default test windows don't overlap and the purge is a whole context."""

    seq: int = 60
    val: int = 126
    horizon: int = 5
    lockbox: int = 252
    step: int | None = None
    purge: int | None = None
    most: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "step", self.val if self.step is None else self.step)
        object.__setattr__(self, "purge", self.seq if self.purge is None else self.purge)
        if min(self.seq, self.val, self.step) < 1 or min(self.horizon, self.lockbox, self.purge) < 0:
            raise ValueError("lengths must be positive")


def numbered(calendar: DataFrame) -> DataFrame:
    """date and ``i`` of each session; one row a date, so their order is one small sort."""
    return calendar.select(DATE).distinct().select(DATE, (F.row_number().over(Window.orderBy(DATE)) - 1).cast("long").alias("i"))


def walk_backward(sessions: DataFrame, shape: Shape) -> DataFrame:
    """A row a fold: fold, inner_end, train_end, test_from (context included), val_start, val_end and sessions.

    Folds end where training has no room for a context and a target for both of its parts.
    """
    n = sessions.agg(F.count("*").alias("sessions"))
    last = F.col("sessions") - shape.horizon - shape.val - shape.lockbox
    fold = n.where(last >= 0).select("sessions", F.explode(F.sequence(F.lit(0), F.floor(last / F.lit(float(shape.step))).cast("int"))).alias("k"))
    plan = fold.select((F.col("k") + 1).alias("fold"), "sessions", (last - F.col("k") * shape.step).alias("val_start"))
    plan = plan.withColumn("train_end", F.col("val_start") - shape.purge).where(F.col("train_end") >= shape.seq + 1)
    inner = F.greatest(F.lit(1), F.rint(INNER_SHARE * (F.col("train_end") - shape.seq)).cast("long"))
    plan = plan.withColumn("inner_end", F.col("train_end") - inner - shape.seq).where(F.col("inner_end") >= shape.seq + 1)
    plan = plan.select("fold", "inner_end", "train_end", F.greatest(F.lit(0), F.col("val_start") - shape.seq).alias("test_from"), "val_start", (F.col("val_start") + shape.val).alias("val_end"), "sessions")
    return plan if shape.most is None else plan.where(F.col("fold") <= shape.most)


def sliced(sessions: DataFrame, plan: DataFrame, shape: Shape) -> DataFrame:
    """fold, role, date, i, ``local`` (from 0 in each slice) and part: ``context``, ``target`` or, for prices only, ``pad``."""
    piece = lambda role, a, b, c: F.struct(F.lit(role).alias("role"), a.alias("a"), b.alias("b"), c.alias("c"))
    col = F.col
    roles = F.array(
        piece("inner_train", F.lit(0).cast("long"), F.lit(shape.seq).cast("long"), col("inner_end")),
        piece("inner_val", col("inner_end"), col("inner_end") + shape.seq, col("train_end")),
        piece("outer_test", col("test_from"), col("val_start"), col("val_end")),
    )
    each = plan.select("fold", "sessions", F.explode(roles).alias("r")).select("fold", "sessions", "r.*")
    each = each.withColumn("i", F.explode(F.sequence(col("a"), F.least(col("c") + shape.horizon, col("sessions")) - 1)))
    part = F.when(col("i") < col("b"), "context").when(col("i") < col("c"), "target").otherwise("pad")
    return each.select("fold", "role", "i", (col("i") - col("a")).alias("local"), part.alias("part")).join(sessions, "i")


def each_fold(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """Every entity with every row of the plan, which travels as one array."""
    held = entities.withColumn("_p", F.explode(plan.agg(F.collect_list(F.struct(*plan.columns))).scalar()))
    return held.select(*entities.columns, *(F.col(f"_p.{c}").alias(c) for c in plan.columns))


def quality(rows: DataFrame, sessions: DataFrame, plan: DataFrame, close: str = "close") -> DataFrame:
    """entity, fold and reason: why the entity's closes before the fold's training end are unusable, or NULL.

    Reasons are ``all_nan``, ``hi_vol`` (deviation of changes from one session to the next) and
    ``extreme_fwd`` (a move over AHEAD sessions). Only rows before the training end are looked at: each row is
    added to the stretch up to the next training end, and stretches are added up by fold.
    """
    ends = plan.agg(F.collect_list(F.struct("fold", "train_end")))  # a row a fold
    # the fold whose training ends next after a session
    upto = F.array_max(F.transform(F.filter("ends", lambda e: e["train_end"] > F.col("i")), lambda e: e["fold"]))
    stretch = sessions.withColumn("ends", ends.scalar()).select(DATE, "i", upto.alias("upto")).where("upto is not null")
    held = rows.where(F.col(close).isNotNull() & ~F.isnan(close)).select(ENTITY, DATE, F.col(close).cast("double").alias("x")).join(stretch, DATE)
    path = Window.partitionBy(ENTITY).orderBy("i")
    ago = lambda n: F.first("x").over(path.rangeBetween(-n, -n))
    held = held.withColumns({"r": (F.col("x") - ago(1)) / (ago(1) + 1e-8), "m": F.abs((F.col("x") - ago(AHEAD)) / (ago(AHEAD) + 1e-8))})
    # a fold's past is its own stretch and those of all folds after it, which end earlier
    by = held.groupBy(ENTITY, "upto").agg(F.count("*").alias("n"), F.count("r").alias("c"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.max("m").alias("m"))
    every = each_fold(rows.select(ENTITY).distinct(), plan.select("fold"))
    past = by.withColumn("fold", F.explode(F.sequence(F.lit(1), "upto"))).groupBy(ENTITY, "fold").agg(*(F.sum(c).alias(c) for c in ("n", "c", "s", "q")), F.max("m").alias("m"))
    mean = F.try_divide(F.col("s"), F.col("c"))
    dev = F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("c")) - mean * mean, F.lit(0.0)))
    reason = F.when(F.coalesce("n", F.lit(0)) == 0, "all_nan").when(dev > MOST_DEVIATION, "hi_vol").when(F.col("m") > MOST_MOVE, "extreme_fwd")
    return every.join(past, [ENTITY, "fold"], "left").select(ENTITY, "fold", reason.alias("reason"))


def usable(judged: DataFrame, least: int = 20) -> DataFrame:
    """fold and entities of the folds that ``least`` entities or more are usable in; the others are left out, numbers stay."""
    return judged.groupBy("fold").agg(F.count_if(F.col("reason").isNull()).alias("entities")).where(F.col("entities") >= least)


def gated(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reason``: the first gate, in order, that a row doesn't pass, or NULL; an unknown passes nothing."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(g, F.lit(False)), name) for name, g in gates.items()), F.lit(None).cast("string")))


def passed(*gates: Column) -> Column:
    """Whether all gates are passed; an unknown passes nothing."""
    return reduce(lambda a, b: a & b, (F.coalesce(g, F.lit(False)) for g in gates))


def delist_index(status: DataFrame, sessions: DataFrame, plan: DataFrame, shape: Shape, delisted: str = "delisted") -> DataFrame:
    """entity, fold and ``forced``: the outer test's session (from 0) of the last one up to the entity's delisting, or -1 outside it and its price pad."""
    # sessions are cut into months, so that the range join is within one
    month = lambda d: F.date_format(d, "yyyyMM").cast("int")
    ends = sessions.select(DATE, "i")
    span = ends.agg(F.min(DATE).alias("first"), F.max(DATE).alias("last"), F.max("i").alias("most"))
    known = status.where(F.col(delisted).isNotNull()).select(ENTITY, F.col(delisted).cast("date").alias("d"))
    upto = ends.withColumn("next", F.coalesce(F.lead(DATE).over(Window.orderBy(DATE)), F.date_add(DATE, 1)))
    cells = upto.withColumn("month", F.explode(F.sequence(F.trunc(DATE, "month"), F.trunc(F.date_sub("next", 1), "month"), F.expr("interval 1 month")))).select("i", F.col(DATE).alias("a"), "next", month("month").alias("month"))
    inside = known.withColumn("month", month("d")).join(cells, "month").where((F.col("a") <= F.col("d")) & (F.col("d") < F.col("next"))).select(ENTITY, "i")
    later = known.where(F.col("d") > span.select("last").scalar()).select(ENTITY, span.select("most").scalar().alias("i"))
    at = inside.unionByName(later)
    local = F.col("i") - F.col("val_start")
    folds = plan.select("fold", "val_start", (F.least(F.col("val_end") + shape.horizon, F.col("sessions")) - F.col("val_start")).alias("width"))
    every = each_fold(status.select(ENTITY).distinct().join(at, ENTITY, "left"), folds)
    return every.select(ENTITY, "fold", F.coalesce(F.when((local >= 0) & (local < F.col("width")), local), F.lit(-1).cast("long")).alias("forced"))
