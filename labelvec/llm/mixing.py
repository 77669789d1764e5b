"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks; built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from labelvec.session import broadcast_if_small, stage

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
# Words of a shard, until a source has MAX_SHARDS of them; from there on shards grow.
SHARD_WORDS = 1 << 18
MAX_SHARDS = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``src`` (1.. by source, null last) and ``target`` to (source, source_size), one row per source.

    The targets share ``share`` times all sizes by weight. None exceeds ``most`` times
    its size: with sources in order of size per weight, those before the first one
    that has room for an equal share of what is left are full.
    """
    every = W.partitionBy()
    order = every.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("src", F.row_number().over(order))
    rows = rows.withColumn("weight", F.element_at(cycle, F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("full", F.lit(float(most)) * F.col("source_size"))
    fill = every.orderBy(F.col("full") / F.col("weight"), "src")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    fits = F.when(F.col("full") >= F.col("level") * F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
    return rows.select("source", "source_size", "src", target.alias("target"))


def sainte_lague(claims: DataFrame, group: str, key: str) -> DataFrame:
    """Deal the ``seats`` of each group to its keys by highest quotients ``votes / (2 k + 1)``; adds ``quota``.

    ``claims`` has (group, key, votes, seats, ...). At divisors for ``seats`` less or
    more than half the number of keys, plain rounding gives too few or too many seats. Only
    quotients between the two are ranked, about four for each key, whatever ``seats``
    is. Ties go to the smaller key.
    """
    own = W.partitionBy(group)
    n, votes = F.count("*").over(own), F.sum("votes").over(own)
    rows = claims.withColumn("_n", n).withColumn("_votes", votes)
    near = lambda half: F.when(F.col("_votes") > 0, F.floor(F.col("votes") * F.greatest(F.lit(0.0), half) / F.col("_votes") + 0.5)).otherwise(0)
    rows = rows.withColumn("_sure", F.greatest(F.lit(0), near(F.col("seats") - F.col("_n") / 2) - 1).cast("long"))
    rows = rows.withColumn("_most", (near(F.col("seats") + F.col("_n") / 2) + 1).cast("long"))
    rows = rows.withColumn("_open", F.col("seats") - F.sum("_sure").over(own))
    ranked = rows.select(group, key, "votes", "_open", F.explode(F.sequence("_sure", "_most")).alias("_k"))
    quotient = F.col("votes") / (2 * F.col("_k") + 1)
    ranked = ranked.withColumn("_rank", F.row_number().over(own.orderBy(quotient.desc(), key, "_k")))
    won = ranked.where("_rank <= _open").groupBy(group, key).agg(F.count("*").alias("_won"))
    out = rows.join(won, [group, key], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_n", "_votes", "_sure", "_most", "_open", "_won")


def _shard(n_shards: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), n_shards).cast("int")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 8,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, first, last, head, row) for each of ``docs`` (doc_id, source, text, ...).

    A source is cut into shards by a seeded hash of doc_id, and the words of a shard, in
    seeded order, into blocks of equal size. Blocks of the whole mix are dealt to
    sources, and those of a source to its shards, by Sainte-Laguë. A shard takes all its blocks
    as often as its quota allows, and for the rest a seeded run of blocks that wraps
    around at the end, so that few documents are cut. ``taken`` is ``copies * size`` plus the words
    [first, last) and [0, head) of the document; ``row`` is the whole row given. Quotas never exceed ``most`` (2) passes.

    Null or blank texts have size 0 and nothing is taken. A null source is a source of its
    own, the last. Repeated rows are rows like any other. An empty table gives no rows.
    ``block_words`` bounds a source's distance from its target, by about one block for each shard.
    The source table passes through one task, one row for each source; it is broadcast only after a count.
    """
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    slim = stage(docs.select("doc_id", "source", "size"), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(sizes, weights, share, most).withColumn(
        "n_shards", F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)))
    )
    sources = sources.withColumn("all", F.lit(1)).withColumn("votes", F.col("target"))
    sources = sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long"))
    sources = sainte_lague(sources, "all", "src").drop("all", "votes", "seats").withColumnRenamed("quota", "blocks")
    sources = stage(sources, "sources")
    small = broadcast_if_small(sources.withColumnRenamed("source", "_source"))
    named = slim.join(small, F.col("source").eqNullSafe(F.col("_source")))
    shards = named.withColumn("shard", _shard(F.col("n_shards"), seed)).groupBy("src", "shard").agg(
        F.sum("size").alias("shard_size"), *[F.first(c).alias(c) for c in ("source_size", "target", "blocks")]
    )
    shards = shards.where("shard_size > 0").withColumn("votes", F.col("target") * F.col("shard_size") / F.col("source_size"))
    shards = sainte_lague(shards.withColumn("seats", F.col("blocks")), "src", "shard")
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / block_words).cast("long"))
    shards = shards.withColumn("quota", F.least("quota", (F.lit(most) * F.col("n_blocks")).cast("long")))
    start = F.pmod(F.xxhash64("src", "shard", F.lit(seed)), F.col("n_blocks"))
    edge = lambda block: F.expr(f"({block}) * shard_size div n_blocks")
    shards = shards.withColumn("copies", F.expr("quota div n_blocks")).withColumn("_from", start)
    shards = shards.withColumn("_to", F.col("_from") + F.expr("quota % n_blocks")).select(
        F.col("src").alias("_src"),
        F.col("shard").alias("_shard"),
        "copies",
        edge("_from").alias("_lo"),
        edge("least(_to, n_blocks)").alias("_hi"),
        edge("greatest(_to - n_blocks, 0L)").alias("_head"),
    )
    shards = stage(shards, "shards")

    rows = docs.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_at_shard", _shard(F.col("n_shards"), seed))
    order = W.partitionBy("src", "_at_shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    rows = rows.withColumn("_end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(
        broadcast_if_small(shards), (F.col("src") == F.col("_src")) & (F.col("_at_shard") == F.col("_shard")), "left"
    )
    begin = F.col("_end") - F.col("size")
    inside = lambda x: F.least(F.greatest(x - begin, F.lit(0)), F.col("size"))
    rows = rows.withColumns({"first": inside(F.col("_lo")), "last": inside(F.col("_hi")), "head": inside(F.col("_head"))})
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("copies", "first", "last", "head")}
    rows = rows.withColumns(zero)
    taken = F.col("copies") * F.col("size") + F.col("last") - F.col("first") + F.col("head")
    return rows.withColumn("taken", taken).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies", "first", "last", "head", "row"
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each full copy and each part of a document that it takes."""
    rows = mix_sources(docs, **settings)
    text = F.col("row.text")

    def piece(lo: Column, hi: Column) -> Column:
        words = F.slice(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), (lo + 1).cast("int"), (hi - lo).cast("int"))
        return F.when(hi - lo == F.col("size"), text).when(hi > lo, F.array_join(words, ""))

    parts = F.array(piece(F.col("first"), F.col("last")), piece(F.lit(0), F.col("head")))
    taken = F.concat(F.array_repeat(text, F.col("copies").cast("int")), F.array_compact(parts))
    rows = rows.where("taken > 0").select("row", F.explode(taken).alias("piece"))
    new = {"text": F.col("piece")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("piece").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
