"""Mixing sources to target weights by Sainte-Lague apportionment.

All sizes are words.  Each source gets a target: its weight's share of all words,
but at most ``max_repeats`` times what it has; what is cut goes to the others by
weight until none is above.  The mix is made of blocks of equally many words:

1. Sources share ``total / block`` blocks by highest quotients target / (2k + 1).
2. A source's documents are dealt by a seeded hash to shards of about
   ``SHARD_WORDS`` words or ``SHARD_ROWS`` rows, whichever gives more, and its blocks are
   shared among its shards in the same way, by their sizes.  Each shard has an integer
   quota, and works alone from here.  Rows that repeat id and text are counted first and
   dealt as runs of at most ``RUN_ROWS``; documents without words take none and are not dealt.
3. In a shard, documents stand in a seeded order; their words, end to end, are
   cut into blocks.  With a quota of q out of n blocks, every block is taken q // n
   times, and q % n of them once more: block j if floor((j + 1) r / n + u) exceeds
   floor(j r / n + u), with a seeded offset u.  That picks exactly r blocks, spread
   evenly over the seeded order.

A document's words taken follow from the words before it in its shard alone: no
block becomes a row.  Everything is DataFrame operations.

The highest quotients are found without listing all blocks: with D = total / N
the seats lie within n * share / 2 + 1 of target / D (n sources; the rounding of n
seats bounds how far the divisor moves), so only so many quotients of each source
are ranked, O(n) rows in all.  Ties go to the source that comes first.

Defined cases: a null text has no words; documents without words take none; null
source is a source, last in order; rows that repeat id and text are separate
documents, each with words of its own; an empty table gives an empty mix.  The per-source table (one row a
source) is ordered in one task; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shiftspark.llm.common import read_table
from shiftspark.session import write_and_read

SPACE = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Blocks are made smaller where a mean source would have fewer than so many.
LEAST_BLOCKS = 2000
SHARD_WORDS = 4_000_000
SHARD_ROWS = 8192
#: Rows equal in id and text stand in line in runs of at most so many.
RUN_ROWS = 1024
SEED = 5


def word_count(text: Column) -> Column:
    """Number of runs without a space or a character of 9 to 13; 0 for null.

    White space between two words shrinks to one character, so the words are one
    more than what is left of it; no list of words is built.
    """
    gaps = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    spaces = F.octet_length(gaps) - F.octet_length(F.replace(gaps, F.lit(" "), F.lit("")))
    return F.when(gaps == "", 0).otherwise(spaces + 1).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, place of every source of ``sizes`` (source, source_size).

    Filling up by weight: with sources ordered by cap / weight, the first k are
    capped, and k is the number of those whose cap lies below what their weight
    would get of the words that the capped ones before them leave.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = (sizes.withColumn("place", F.row_number().over(order) - 1)
         .withColumn("w", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * float(MAX_REPEATS)))
    rise = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(rise), F.lit(0.0)))
         .withColumn("wleft", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rise), F.lit(0.0)))
         .withColumn("capped", F.col("cap") <= F.col("left") * F.col("w") / F.col("wleft")))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "place", F.col("left") / F.col("wleft")))).over(whole)
    return (s.withColumn("level", level.getField("col3"))
            .select("source", "source_size", "place",
                    F.when(F.col("level").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target")))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: str, into: str) -> DataFrame:
    """``parties`` with ``into``: their seats, of the group's number in ``seats``.

    Parties with more votes / (2k + 1) come first; ties by ``order``.
    """
    of = Window.partitionBy(*group) if group else Window.partitionBy()
    p = (parties.withColumn("_votes", F.sum(votes).over(of)).withColumn("_n", F.count("*").over(of))
         .withColumn("_share", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)))
    quota = F.col("_share") * F.col(seats)
    slack = F.ceil(F.col("_n") * F.col("_share") / 2) + 1
    p = p.withColumn("_base", F.greatest(F.lit(0), F.floor(quota) - slack).cast("long")).withColumn(
        "_top", (F.floor(quota) + slack + 1).cast("long"))
    free = (F.col(seats) - F.sum("_base").over(of)).cast("long")
    p = p.withColumn("_free", free)
    c = (p.select(*group, order, votes, "_free", F.explode(F.sequence("_base", "_top")).alias("_k"))
         .where(F.col(votes) > 0)
         .withColumn("_rank", F.row_number().over(
             (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(
                 F.desc(F.col(votes) / (2 * F.col("_k") + 1)), order, "_k")))
         .where("_rank <= _free").groupBy(*group, order).agg(F.count("*").alias("_won")))
    return (p.join(c, [*group, order], "left")
            .withColumn(into, (F.col("_base") + F.coalesce("_won", F.lit(0))).cast("long"))
            .drop("_votes", "_n", "_share", "_base", "_top", "_free", "_won"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, source_size, target, taken of every row."""
    sized = write_and_read(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col)).alias("h")), "sizes")
    lines = write_and_read(sized.where("size > 0").groupBy("source", "id", "h", "size").agg(F.count("*").alias("copies")), "lines")
    per_source = (lines.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
                  .unionByName(sized.where("size = 0").select("source").distinct().select(
                      "source", F.lit(0).cast("long").alias("source_size"), F.lit(0).cast("long").alias("rows")))
                  .groupBy("source").agg(F.sum("source_size").alias("source_size"), F.sum("rows").alias("rows")))
    per_source = targets(per_source.select("source", "source_size")).join(per_source.select(F.col("source").alias("_s"), "rows"),
                                                                          F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(total / (F.count("*").over(whole) * LEAST_BLOCKS)))).cast("long")
    per_source = (per_source.withColumn("block", block).withColumn("blocks", F.round(total / F.col("block")).cast("long")))
    per_source = sainte_lague(per_source, [], "target", "blocks", "place", "quota")
    per_source = write_and_read(per_source.withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS)).cast("int")), "sources")

    small = per_source.select(F.col("source").alias("_s"), "place", "shards", "source_size", "target")
    runs = (lines.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN_ROWS))))
            .withColumn("copies", F.least(F.lit(RUN_ROWS), F.col("copies") - F.col("run") * RUN_ROWS).cast("int")))
    dealt = (runs.join(small, F.col("source").eqNullSafe(F.col("_s")))
             .withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "h", "run"), F.col("shards")).cast("int"))
             .select("id", "size", "h", "run", "copies", "place", "shard"))
    shards = dealt.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"))
    shards = sainte_lague(shards.join(per_source.select("place", "source_size", "target", "block", "quota"), "place"),
                          ["place"], "shard_size", "quota", "shard", "shard_quota")
    n = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    shards = (shards.withColumn("n", n)
              .withColumn("q", F.least(F.col("shard_quota"), F.col("n") * MAX_REPEATS))
              .withColumn("full", F.when(F.col("n") > 0, F.floor(F.col("q") / F.col("n"))).otherwise(0).cast("long"))
              .withColumn("r", F.col("q") - F.col("full") * F.col("n"))
              .withColumn("u", F.pmod(F.xxhash64(F.lit(SEED + 2), "place", "shard"), F.greatest("n", F.lit(1))))
              .select(F.col("place").alias("_p"), F.col("shard").alias("_sh"), "source_size", "target", "block", "n", "full", "r", "u"))
    shards = write_and_read(shards, "shards")

    line = Window.partitionBy("place", "shard").orderBy("h", "id", "size", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (dealt.withColumn("to", F.sum(F.col("size") * F.col("copies")).over(line))
              .withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.col("to") - k * F.col("size"))))
              .join(shards, (F.col("place") == F.col("_p")) & (F.col("shard") == F.col("_sh"))))

    def picked(j: Column) -> Column:
        """How many of the first j blocks are taken once more (u counts in n-ths)."""
        return F.floor((j * F.col("r") + F.col("u")) / F.greatest("n", F.lit(1))).cast("long")

    def words(x: Column) -> Column:
        """Words taken once more of the first x of the shard."""
        j = F.floor(x / F.col("block")).cast("long")
        return picked(j) * F.col("block") + (x - j * F.col("block")) * (picked(j + 1) - picked(j))

    to = F.col("to")
    taken = (F.col("full") * F.col("size") + words(to) - words(to - F.col("size"))).cast("long")
    none = sized.where("size = 0").join(small, F.col("source").eqNullSafe(F.col("_s")))
    return (placed.select("id", "size", "source_size", "target", taken.alias("taken"))
            .unionByName(none.select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
            .withColumnRenamed("id", id_col))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(read_table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: doc_id, size, source_size, target, taken of every document."""
    return mix(docs)
