"""What a line of a session file needs to know of the lines before it, for batches of whole files and for open files alike.

A normaliser says what is carried (`Carried`), works out facts of single lines, has them carried along each file, and makes
events of the result. Batches carry by windows over a file (`by_windows`), streams by state per file
(`sparktrail.streaming.tail.by_state`); both add the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Carried:
    """Columns (texts, but for ts) of facts to be carried along a file; nulls are no facts.

    last: adds last_<c>, the latest fact up to the line. previous: adds previous_<c>, the latest before the line. first: adds
    first_<c>. fresh: adds `fresh`, whether the line's key is new to the file. named: (definitions array<struct<id, name,
    ts>>, references array<text>), adds `known`, a map of the line's references to the first definition in it or before it.
    Always added: begins (the first line with a ts), from_ts and to_ts (so far), ended (after it, the file is complete).
    """

    last: tuple[str, ...] = ()
    previous: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    fresh: str | None = None
    named: tuple[str, str] | None = None


Carry = Callable[[DataFrame, Carried], DataFrame]
DEFINITION = "struct<name: string, ts: long>"


def by_windows(lines: DataFrame, spec: Carried) -> DataFrame:
    """For whole files: (file, line_no, ts, facts) with the carried columns."""
    order = Window.partitionBy("file").orderBy("line_no")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    new = {f"last_{c}": F.last(c, ignorenulls=True).over(upto) for c in spec.last}
    new |= {f"previous_{c}": F.last(c, ignorenulls=True).over(before) for c in spec.previous}
    new |= {f"first_{c}": F.first(c, ignorenulls=True).over(upto) for c in spec.first}
    new |= {"from_ts": F.min("ts").over(upto), "to_ts": F.max("ts").over(upto), "ended": F.lead("line_no").over(order).isNull()}
    new["begins"] = F.col("ts").isNotNull() & (F.count("ts").over(before) == 0)
    if spec.fresh:
        new["fresh"] = F.col(spec.fresh).isNotNull() & (F.row_number().over(Window.partitionBy("file", spec.fresh).orderBy("line_no")) == 1)
    out = lines.withColumns(new)
    if not spec.named:
        return out
    given, asked = spec.named
    definitions = lines.select(F.col("file").alias("_f"), F.col("line_no").alias("_n"), F.explode(given).alias("d")).filter("d.id is not null")
    references = lines.select(F.col("file").alias("_file"), F.col("line_no").alias("_line"), F.explode(asked).alias("r")).filter("r is not null").distinct()
    met = references.join(definitions, (F.col("_file") == F.col("_f")) & (F.col("r") == F.col("d.id")) & (F.col("_n") <= F.col("_line")))
    one = met.groupBy("_file", "_line", "r").agg(F.min_by(F.struct("d.name", "d.ts"), "_n").cast(DEFINITION).alias("d"))
    maps = one.groupBy("_file", "_line").agg(F.map_from_entries(F.collect_list(F.struct("r", "d"))).alias("known"))
    return out.join(maps, (F.col("file") == F.col("_file")) & (F.col("line_no") == F.col("_line")), "left").drop("_file", "_line")
