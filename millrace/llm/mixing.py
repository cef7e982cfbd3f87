"""Mixing sources to target weights by Poisson replication.

A source with n documents and the share w of a corpus of T documents is repeated at the mean rate r = T * w / n. The number of
copies of a document is the inverse Poisson distribution function of mean r at a uniform number that follows from a seed
and the document, so a rerun, a retry or another partitioning gives the same corpus. Copies are dealt to partitions by a hash of
their random key and sorted by that key there: a global shuffle without a sampling pass.

All of it is DataFrame functions. The distribution functions are one array per source, joined to the documents: broadcast
if their total size was counted and is small, else by a join that Spark may split for hot sources.

Cases: a null source is a source of its own. A source without a weight gets none and disappears if weights are
given; without weights the share of a source follows its size to the power `temperature`. A null doc_id is replaced by a
digest of the text; rows that repeat a doc_id get the same number of copies. An empty table gives an empty one. Columns of the
input that are named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import stored

#: Numbers in all distribution functions together up to which they are broadcast (8 bytes each).
BROADCAST_NUMBERS = 250_000

ADDED = ("mix_rate", "mix_copy", "mix_key")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def repetition_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = 0.5
) -> DataFrame:
    """(key, n, rate) per source."""
    sizes = docs.groupBy(source_key(F.col("source")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("key")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = stored(sizes.withColumn("share", share), "sources")
    shares, documents = sizes.agg(F.sum("share"), F.sum("n")).first()
    wanted = documents if total is None else total
    rate = F.col("share") / F.col("n") * F.lit(float(wanted) / shares if shares else 0.0)
    return sizes.select("key", "n", rate.alias("rate"))


def distribution_functions(rates: DataFrame) -> DataFrame:
    """(key, rate, cdf): the Poisson distribution function at 0, 1, 2, ... until it is 1 in double precision."""
    last = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 30).cast("long")
    rows = rates.filter("rate > 0").select("key", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    upto = Window.partitionBy("key").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_k = F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)
    rows = rows.withColumn("log_factorial", F.sum(log_k).over(upto))
    rows = rows.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial")))
    rows = rows.withColumn("cdf", F.sum("p").over(upto))
    pairs = F.sort_array(F.collect_list(F.struct("k", "cdf")))
    return rows.groupBy("key", "rate").agg(F.transform(pairs, lambda x: x["cdf"]).alias("cdf"))


def uniform(text: Column) -> Column:
    """A number in [0, 1) of 52 bits from a digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    temperature: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """The shuffled corpus: all columns, with `mix_rate`, `mix_copy` (1, 2, ...) and `mix_key`, which gives the order."""
    docs = docs.drop(*ADDED)
    functions = stored(distribution_functions(repetition_rates(docs, weights, total, temperature)), "poisson")
    numbers = functions.agg(F.sum(F.size("cdf"))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        functions = F.broadcast(functions)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = docs.withColumns({"__key": source_key(F.col("source")), "__name": F.concat(F.lit(f"{seed}:"), name)})
    found = keyed.join(functions.withColumnsRenamed({"key": "__key", "rate": "mix_rate", "cdf": "__cdf"}), "__key")
    copies = F.size(F.filter("__cdf", lambda p: p < uniform(F.col("__name"))))
    found = found.withColumn("__copies", copies).drop("__cdf").filter("__copies > 0")
    found = found.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = F.md5(F.concat("__name", F.lit(":"), F.col("mix_copy").cast("string")).cast("binary"))
    found = found.withColumn("mix_key", order).drop("__key", "__name", "__copies")
    return found.repartition("mix_key").sortWithinPartitions("mix_key")
