"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import buckets_for, running_total
from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> Column:
    """Weights given to sources in code point order, null last, repeating."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int"))


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add `target` to one row per source (source, source_size, weight).

    Sources share the total by weight; a target stops at max_epochs times its source's size and the excess is shared
    among the others. With sources in order of cap / weight, the first i are capped where the share of the rest no
    longer exceeds their own cap: one pass of prefix sums, instead of repeated rounds. The table has a row per source.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumns(
        {
            "turn": F.row_number().over(order),
            "open_words": F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    # each weight's share if exactly the sources before this one are capped; the first source that stays below its cap decides
    sizes = sizes.withColumn("share", F.col("open_words") / F.col("open_weight"))
    sizes = sizes.withColumn("first_open", F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("turn", "share")))
    sizes = sizes.withColumn("share", F.min("first_open").over(everything)["share"])
    return sizes.withColumn("target", F.least(F.col("cap"), F.col("share") * F.col("weight"))).drop("cap", "turn", "open_words", "open_weight", "share", "first_open")


def mix(docs: DataFrame, weights: Column | None = None, max_epochs: int = 3, carry: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    Documents get hash-random keys; sources are ordered by key (in key ranges, so that a large source is spread over many
    tasks), word counts are accumulated, and each source is cut exactly at its target: whole epochs first, then the
    documents before the cut, and of the document at the cut the words up to it. A null text or one without words has
    size 0 and taken 0; a null source is a source of its own; repeated rows count as rows; an empty table gives no rows.
    carry: also return the whole input row, as struct `document`.
    """
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")] if carry else []
    sized = docs.select("doc_id", F.col("source").cast("string"), *whole, word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.col("text")).alias("mix_key"))
    if not carry:
        sized = materialize(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_source = materialize(targets(by_source.withColumn("weight", weights if weights is not None else cycle_weights()), max_epochs), "targets")
    rows = by_source.agg(F.sum("source_rows")).first()[0] or 0
    ordered = running_total(sized, "source", ["mix_key", "doc_id", "size"], F.col("size"), buckets_for(rows * (8 if carry else 1)), "words_before")  # whole rows are larger
    t = by_source.select(F.col("source").alias("target_source"), "source_size", "target")
    out = ordered.join(t, F.col("source").eqNullSafe(F.col("target_source")), "left").drop("target_source", "mix_key")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("words_before")))
    return out.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("words_before")


def mixed_documents(docs: DataFrame, weights: Column | None = None, max_epochs: int = 3) -> DataFrame:
    """The mix as rows of docs: a row per whole time that a document is taken, and one with its first words at the cut.

    The text at a cut is those words joined by one space; n_chars, where it exists, is then counted anew. Null texts and
    those without words are never taken; a null source is a source of its own; each of several equal rows is taken for
    itself; an empty table gives no rows. Other columns come through unchanged, whatever their names.
    """
    out = mix(docs, weights, max_epochs, carry=True).filter("taken > 0")
    out = out.select("document", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    some = F.split(F.regexp_replace("document.text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    begin = F.when(left < F.col("size"), F.array_join(F.slice(some, F.lit(1), F.greatest(left, F.lit(1)).cast("int")), " "))
    out = out.select("document", begin.alias("begin"))
    new = {"text": F.coalesce("begin", "document.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("begin").isNotNull(), F.char_length("begin").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars"))
    return out.select(*(new.get(c, F.col("document").getField(c)).alias(c) for c in docs.columns))
