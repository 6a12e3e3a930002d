"""Mixing sources to target weights.

Every source gets a share of the mix by its weight, at most ``EPOCHS`` times its own words; what it cannot take goes
to the others by their weights. Documents are range-sorted by source and a random key that a hash of the id gives;
distributed prefix sums of their words say where the budget of a source ends. Whole epochs are repeated, the last one
ends at exactly the budget, within a document if need be. All of it is built-in Spark functions.

Nothing depends on the number of rows of a source or on the number of sources: both tables are sorted and summed by
range, so a source with a third of all rows lies on many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pointweave.llm.common import SPACE, WORD, running_sums
from pointweave.session import cut

WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = (3, 2)  # words of the mix to words of all documents, as a fraction
EPOCHS = 2  # most times that a source is taken


def _random(key: Column) -> Column:
    """Random but repeatable place of a document in its source."""
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 16)


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, start, target) of the rows (source, source_size), one for each source.

    ``start`` is the number of words of the sources in front, in code-point order with null last. A source whose
    weighted share exceeds ``epochs`` times its words is capped there. With the sources sorted by the share at
    which they reach their cap, those capped come first: one is capped if the budget that those in front leave,
    shared by weight among the rest, reaches its cap.
    """
    ordered = running_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ["one", "source_size"])
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    capped = ordered.select("source", "source_size", F.col("before_source_size").alias("start"), weight.alias("weight"),
                            (F.col("source_size") * epochs).alias("cap"))
    filled = cut(running_sums(capped.withColumn("reached", F.col("cap") / F.col("weight")),
                              [F.col("reached").asc(), F.col("source").asc_nulls_last()], ["cap", "weight"]))
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, all_weight = total["words"] or 0, total["weight"] or 0
    over, under = share
    left = F.lit(float(over * words)) - F.col("before_cap").cast("double") * under
    full = F.col("cap").cast("double") * under * (F.lit(float(all_weight)) - F.col("before_weight")) <= F.col("weight") * left
    marked = cut(filled.withColumn("full", full))
    rest = marked.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).alias("cap"),
                      F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).alias("weight")).first()
    shared = over * words - under * (rest["cap"] or 0)
    by_weight = (F.col("weight") * F.lit(shared).cast("long")).cast("double") / F.lit(float(under * (rest["weight"] or 1)))
    return marked.select("source", "source_size", "start", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(by_weight).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs: int = EPOCHS, text: str = "text", source: str = "source",
         key: str = "doc_id") -> DataFrame:
    """(key, content, source, size, source_size, target, taken) of every row: how many of its words the mix takes.

    Words are runs of other characters than ASCII white space; ``content`` is a hash of the text. ``taken`` counts
    repeats, adds up to the target of the source, rounded down, and is at most ``epochs`` times ``size``. A null text
    has no words and gives none. A null source is a source of its own. Null keys share a random place, repeated rows
    a key and ties of keys are ordered by key, size and content, so reruns agree; of rows alike in all of these any
    may be the one that the cut meets. Texts of any length are counted whole; an empty table gives an empty one; other
    columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # The number of the row keeps apart what is equal otherwise, so that any number of copies can be split.
    rows = cut(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(body).alias("content"), _random(F.col(key)).alias("place"), F.monotonically_increasing_id().alias("row")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    order = [F.col("source").asc_nulls_last(), *[F.col(c).asc() for c in ("place", "key", "size", "content", "row")]]
    placed = running_sums(rows, order, ["size"]).withColumnRenamed("source", "own")
    met = placed.join(cut(sources), F.col("own").eqNullSafe(F.col("source")))
    budget, size = F.floor("target"), F.col("source_size")
    whole = F.when(size > 0, F.floor(budget / size)).otherwise(0)
    met = met.withColumn("whole", whole).withColumn("rest", budget - F.col("whole") * size)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("before_size") - F.col("start"))))
    return met.select(F.col("key").alias(key), "content", "source", "size", "source_size", "target",
                      (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, planned: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, source, epoch, text): the mix itself, one row for each time that a document is taken.

    ``planned`` is the plan of ``docs``. The text that ends a source is cut to its words, joined by a space.
    Documents without words are in no epoch.
    """
    takes = planned.where("taken > 0").groupBy(F.col(key).alias("__key"), "content", "source", "size").agg(F.sum("taken").alias("taken"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col(f"`{key}`").alias("own"), F.col("source").alias("own_source"), body.alias("body"))
    texts = texts.groupBy("own", "own_source", F.xxhash64("body").alias("own_content")).agg(F.first("body").alias("body"))
    same = (F.col("own").eqNullSafe(F.col("__key")) & F.col("own_source").eqNullSafe(F.col("source"))
            & (F.col("own_content") == F.col("content")))
    met = takes.join(texts, same).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    words = F.filter(F.split("body", SPACE), lambda w: w != "")
    cut_text = F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")
    return met.select(F.col("__key").alias(key), "source", F.col("epoch").cast("long"),
                      F.when(left >= F.col("size"), F.col("body")).otherwise(cut_text).alias(text))
