"""Which stored outputs are still good: digests of what they were made from, and what hangs on what.

A record has one row an output partition and input partition: what it was made from, with the digest that
the input had, and hashes of the settings and the code. An output is stale if one of these is not what it is
now, if an input partition has gone or come, or if what it was made from is stale.

Digests don't depend on the order of rows or on how they are dealt out. They and the records are small
(a row a partition and dependency); the data are read once, to digest them.

Defined results: columns of a digest are taken by name, whatever their order; a null partition is one like
any other; an output that is asked for and has no record is stale; dependencies in a circle end.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.session import dropped, stored

RECORD = "output string, partition string, input string, input_partition string, digest string, config string, code string"


def hash_of_settings(settings: dict) -> str:
    """The same for equal settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def hash_of_code(*functions: Callable) -> str:
    return hashlib.sha256("\n".join(inspect.getsource(f) for f in functions).encode()).hexdigest()[:16]


def digests(df: DataFrame, partition: str, name: str) -> DataFrame:
    """input, input_partition and digest of each partition of ``df``: count, and the sums of the halves of its rows' hashes."""
    columns = sorted(c for c in df.columns if c != partition)
    row = F.xxhash64(*(F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in columns))
    half = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    by = df.select(F.col(partition).cast("string").alias("input_partition"), row.alias("_h")).groupBy("input_partition").agg(
        F.count("*").cast("string").alias("_n"), half(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_a"), half(F.shiftrightunsigned("_h", 32)).alias("_b")
    )
    schema = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return by.select(F.lit(name).alias("input"), "input_partition", F.sha2(F.concat_ws("|", F.lit(schema), "_n", "_a", "_b"), 256).alias("digest"))


def record(depends: DataFrame, now: DataFrame, config: dict[str, str], code: dict[str, str]) -> DataFrame:
    """Rows to store when outputs were made: ``depends`` (output, partition, input, input_partition) with the digests of ``now``."""
    sealed = depends.join(now.select(F.col("input").alias("_i"), F.col("input_partition").alias("_p"), "digest"), (F.col("input") == F.col("_i")) & F.col("input_partition").eqNullSafe(F.col("_p")), "left")
    of = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("output")] if m else F.lit(None).cast("string")
    return sealed.select("output", "partition", "input", "input_partition", "digest", of(config).alias("config"), of(code).alias("code"))


def changed(recorded: DataFrame, depends: DataFrame, now: DataFrame, config: dict[str, str], code: dict[str, str]) -> DataFrame:
    """output, partition and reason of what differs from its record by itself: ``config``, ``code``, ``source`` or ``missing``.

    ``depends`` says what would be read now. Inputs that are outputs themselves have no digest in ``now``.
    """
    fresh = record(depends, now, config, code)
    key = ["output", "partition", "input", "input_partition"]
    old = recorded.select(*(F.col(c).alias(f"o_{c}") for c in recorded.columns))
    both = fresh.join(old, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in key)), "full_outer")
    known = recorded.select(F.col("output").alias("r_output"), F.col("partition").alias("r_partition")).distinct()
    at = both.withColumns({"at": F.coalesce("output", "o_output"), "part": F.when(F.col("output").isNull(), F.col("o_partition")).otherwise(F.col("partition"))})
    at = at.join(known, (F.col("at") == F.col("r_output")) & F.col("part").eqNullSafe(F.col("r_partition")), "left")
    lone = F.col("output").isNull() | F.col("o_output").isNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("r_output").isNull(), "missing"),
        F.when(F.col("r_output").isNotNull() & (lone | ~F.col("digest").eqNullSafe(F.col("o_digest"))), "source"),
        F.when(~lone & ~F.col("config").eqNullSafe(F.col("o_config")), "config"),
        F.when(~lone & ~F.col("code").eqNullSafe(F.col("o_code")), "code"),
    ))
    return at.select(F.col("at").alias("output"), F.col("part").alias("partition"), F.explode(reasons).alias("reason")).distinct()


def stale(depends: DataFrame, first: DataFrame) -> DataFrame:
    """output, partition and ``steps``: all that hangs on the changed outputs ``first``, by the shortest way (0: changed itself).

    Each round joins what the last one found to its dependents, so rounds are as many as the chain of outputs
    is long; what was found is written between them.
    """
    edges = stored(depends.select("output", "partition", F.col("input").alias("_i"), F.col("input_partition").alias("_p")).distinct())
    found = [stored(first.select("output", "partition").distinct().withColumn("steps", F.lit(0)))]
    while not found[-1].isEmpty():
        seen = reduce(DataFrame.unionByName, found)
        last = found[-1].select(F.col("output").alias("_o"), F.col("partition").alias("_q"))
        on = (F.col("_i") == F.col("_o")) & F.col("_p").eqNullSafe(F.col("_q"))
        reached = edges.join(last, on, "left_semi").select("output", "partition").distinct()
        held = seen.select(F.col("output").alias("_o"), F.col("partition").alias("_q"))
        new = reached.join(held, (F.col("output") == F.col("_o")) & F.col("partition").eqNullSafe(F.col("_q")), "left_anti")
        found.append(stored(new.withColumn("steps", F.lit(len(found)))))
    dropped(edges)
    return reduce(DataFrame.unionByName, found)
