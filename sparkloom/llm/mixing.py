"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

1. A document's size is its number of words. Sources are summed (one row a source).
2. Targets: the sources share `share` times all sizes by weight; no target may pass
   `cap` times its source's size, and what a capped source can't take is shared again
   by weight (water filling, in closed form over the sorted caps).
3. A source whose target is r times its size takes floor(r) certain copies of every
   document. The remainder is a fixed-size sample drawn without replacement, with inclusion
   odds p/(1-p): p = min(1, rate * size ** 0.5), where the rate of a source makes the words
   that are expected, sum(p * size), its remainder (solved in closed form over its distinct
   sizes). Documents of p = 1 are taken; the others are ranked by random odds u/(1-u) over
   inclusion odds, the lowest first, until the remainder's words are reached. The last
   document is the one whose inclusion ends nearest.

Running totals in a source don't meet in one task: ranks are cut into cells by the bits
of their rank, words are summed by cell (map-side), totals run over cells, and only the
cell in which a source's cut lies is ordered document by document, after a second cut
into finer cells. Rows of one id and one text have one rank; where a source's cut falls
among such rows, as many of them are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, carried, materialize, scope, uncarried

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Cells on each of the two levels.
CELLS = 4096


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: one row a source, null last. Its windows run over sources, not rows."""
    order = Window.orderBy(F.col(source).asc_nulls_last())
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    per = per.withColumn("nth", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("top") / F.col("weight"), "nth")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("rate", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level is the rate of the first source, in the order of the caps, that stays below its cap at it.
    per = per.withColumn("turn", F.row_number().over(fill))
    per = per.withColumn("level", F.min(F.when(F.col("rate") * F.col("weight") <= F.col("top"), F.struct("turn", "rate"))).over(whole)["rate"])
    # Without a level every source is at its cap.
    return per.select(source, "source_size", F.least("top", F.coalesce(F.col("level") * F.col("weight"), F.col("top"))).alias("target"))


def random_odds(seed: int, doc_id: str, text: str) -> Column:
    """u/(1-u); u comes from a hash of the id and the text, so reruns agree and rows that share an id differ."""
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    u = (F.conv(F.substring(F.md5(own.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return u / (1.0 - u)


def source_rates(narrow: DataFrame, weights, share: float, cap: float, tilt: float) -> DataFrame:
    """s, source_size, target, certain (copies of all), rest (words of the remainder), rate, whole (documents of more words have p = 1). One row a source.

    narrow: s (source), size. The windows run over sources, or over a source's distinct sizes.
    """
    per = source_targets(narrow, "s", weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("certain", F.least(F.floor(ratio), F.lit(int(cap))).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    sizes = narrow.where("size > 0").groupBy("s", "size").agg(F.count("*").alias("n"))
    sizes = sizes.join(per.select(F.col("s").alias("of"), "rest"), F.col("s").eqNullSafe(F.col("of")))
    below = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce(F.sum(F.col("n") * F.col("size")).over(above), F.lit(0))
    sizes = sizes.withColumn("rate", (F.col("rest") - words) / F.sum(F.col("n") * F.pow("size", F.lit(1.0 + tilt))).over(below))
    # The largest size whose documents aren't certain at the rate that leaves all larger ones certain.
    fits = F.when(F.col("rate") * F.pow("size", F.lit(tilt)) <= 1, F.struct("size", "rate"))
    rates = sizes.groupBy(F.col("s").alias("of")).agg(F.max(fits).alias("fit")).select("of", F.col("fit.size").alias("whole"), F.col("fit.rate").alias("rate"))
    return per.join(rates, F.col("s").eqNullSafe(F.col("of")), "left").drop("of")


def inclusion(tilt: float) -> Column:
    """p of a row with the columns size, rest, rate and whole; 0 where its source has no remainder."""
    p = F.when(F.col("size") > F.col("whole"), 1.0).otherwise(F.least(F.lit(1.0), F.col("rate") * F.pow("size", F.lit(tilt))))
    return F.when((F.col("size") > 0) & (F.col("rest") > 0), p).otherwise(0.0)


def rank() -> Column:
    """Random odds over inclusion odds; null where p is 0."""
    return F.when(F.col("p") > 0, F.col("odds") * (1.0 - F.col("p")) / F.col("p"))


def source_cuts(ranked: DataFrame) -> DataFrame:
    """s, cut_rank, cut_take, cut_of: the rank in which a source's remainder ends, and how many of how many rows of that rank are taken.

    ranked: s, size, rest, rank (rows that can be taken).
    """
    slim = ranked.select("s", "size", "rest", "rank", _cell("rank").alias("fine"))
    run = lambda by: Window.partitionBy("s").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    def cut(words: DataFrame, by: str, base) -> DataFrame:
        """Of words by source and `by`: the entry in which the source's remainder ends."""
        words = words.withColumn("before", base + F.coalesce(F.sum("words").over(run(by)), F.lit(0)))
        return words.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))

    def inside(rows: DataFrame, place, at: DataFrame, by: str) -> DataFrame:
        """Rows that lie in their source's entry, with the words before it."""
        at = at.select(F.col("s").alias("of"), F.col(by).alias("here"), F.col("before").alias("base"))
        return rows.join(at, F.col("s").eqNullSafe(F.col("of")) & (place == F.col("here"))).drop("of", "here")

    coarse = F.floor(F.col("fine") / CELLS).cast("long")
    cells = slim.groupBy("s", coarse.alias("cell")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    rows = inside(slim, coarse, cut(cells, "cell", F.lit(0)), "cell")
    finer = rows.groupBy("s", "fine").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    rows = inside(rows.drop("base"), F.col("fine"), cut(finer, "fine", F.col("base")), "fine")
    edge = rows.groupBy("s", "rank").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"), F.count("*").alias("rows"), F.max("size").alias("each"))
    edge = cut(edge, "rank", F.col("base"))
    take = F.least(F.col("rows"), F.floor((F.col("rest") - F.col("before")) / F.col("each") + 0.5).cast("long"))
    take = F.when(F.col("before") + F.col("words") <= F.col("rest"), F.col("rows")).otherwise(take)
    return edge.select("s", F.col("rank").alias("cut_rank"), take.alias("cut_take"), F.col("rows").alias("cut_of"))


def _cell(rank: str):
    """The fine cell of a rank; x/(1+x) lies in [0, 1) and grows with x."""
    x = F.col(rank)
    return F.least(F.floor(x / (1.0 + x) * float(CELLS * CELLS)), F.lit(CELLS * CELLS - 1)).cast("long")


#: Sources up to which the table of sources is broadcast; beyond it, rows and sources are shuffled.
BROADCAST_SOURCES = 100_000


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, tilt: float = 0.5) -> DataFrame:
    """All rows of `docs` with size, source_size, target, copies (times the mix takes the row), taken (words) and inclusion (p of the remainder).

    A null text has size 0, as an empty one; size 0 takes no words. A null source is a source,
    the last; a null id is an id. Any order of rows gives the same mix, up to which of rows that agree
    in id and text are taken. Empty tables give no rows. Other columns pass through, whatever their names;
    columns named as the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "inclusion")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = carried(docs, s=F.col(source), size=size, odds=random_odds(seed, doc_id, text))
    # The narrow columns are read several times below: words are counted once for them.
    with scope(spark):
        narrow = materialize(spark, rows.select("s", "size", "odds"), "mix-sizes")
        rates = materialize(spark, source_rates(narrow, weights, share, cap, tilt).coalesce(1), "mix-rates")
        few = rates.count() <= BROADCAST_SOURCES
        by_source = lambda df, per: df.join((F.broadcast(per) if few else per).withColumnRenamed("s", "of"), F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
        ranked = by_source(narrow, rates.select("s", "rest", "rate", "whole")).withColumn("p", inclusion(tilt)).withColumn("rank", rank())
        cuts = materialize(spark, source_cuts(ranked.where(F.col("rank").isNotNull())).coalesce(1), "mix-cuts")
        per = rates.join(cuts.withColumnRenamed("s", "of"), F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
        per = materialize(spark, per.coalesce(1), "mix-sources", keep=True)
    rows = by_source(rows, per).withColumn("p", inclusion(tilt)).withColumn("rank", rank())
    more = F.coalesce(F.col("rank") <= F.col("cut_rank"), F.lit(False))
    tied = F.coalesce((F.col("rank") == F.col("cut_rank")) & (F.col("cut_take") < F.col("cut_of")), F.lit(False))
    if per.where("cut_of > 1 AND cut_take < cut_of").isEmpty():
        rows = rows.withColumn("more", more & ~(tied & (F.col("cut_take") == 0)))
    else:
        rows = rows.withColumn("more", more & ~tied).where(~tied).unionByName(_some(rows.where(tied)))
    copies = (F.coalesce("certain", F.lit(0)) + F.when((F.col("size") > 0) & F.col("more"), 1).otherwise(0)).cast("long")
    rows = rows.withColumn("copies", copies)
    new = {"size": F.col("size"), "source_size": F.coalesce("source_size", F.lit(0)), "target": F.coalesce("target", F.lit(0.0)), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size"), "inclusion": F.col("p")}
    return uncarried(rows, docs, **new)


def _some(rows: DataFrame) -> DataFrame:
    """Rows of their sources' cut ranks, with `more` true for cut_take of each: counted by partition, then numbered within one."""
    rows = materialize(rows.sparkSession, rows.withColumn("nth", F.monotonically_increasing_id()), "mix-ties", keep=True)
    part = F.shiftright("nth", 33)
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("s", part.alias("part")).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bases = bases.select(F.col("s").alias("of"), "part", "base")
    place = F.row_number().over(Window.partitionBy("s", part).orderBy("nth"))
    out = rows.withColumn("place", place).join(bases, F.col("s").eqNullSafe(F.col("of")) & (part == F.col("part")))
    return out.withColumn("more", F.col("base") + F.col("place") <= F.col("cut_take")).drop("nth", "place", "of", "part", "base")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as the mix takes it, with the columns of `docs`.

    Rows without words (null and empty texts) are taken as often as their source is in whole. Nulls, ties,
    repeated rows and empty tables count as in `mix`; columns pass through, whatever their names.
    """
    columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    names = {n: columns[options.get(n, n)] for n in ("doc_id", "text", "source")}
    mixed = mix(docs.toDF(*columns.values()), **{**options, **names}).where("copies > 0")
    copied = mixed.select(*columns.values(), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copied.select(*[F.col(n).alias(c) for c, n in columns.items()])
