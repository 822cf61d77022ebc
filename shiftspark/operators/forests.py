"""M3-M7, M9, M10 for many data sets: a pair of random forests for each, all grown in one job.

A service keeps a model for every upload.  Here the data set is a column: the trees of
all data sets grow together, level by level, and a level is three DataFrame steps.

1. Every drawn row stands at a node of every tree.  Rows are summed by (data set, target,
   tree, node, feature, value), map-side first, so a large data set spreads over all tasks.
2. Running sums over a feature's values give every possible split of a node; the one that
   lowers the squared error most wins, ties by feature, then by threshold.
3. Rows go down by a join on the splits.  Rows of leaves leave.

No sampling of thresholds: each value of a feature is its own bin, so splits are exact,
with no bound on the entities.  What one window holds is a node's values of one
feature: at most 366, or the data set's entities.

A bootstrap draws each row with Poisson(1) counts, from a digest of the row's own columns
and the tree's number: no order of rows or partitions matters, and a lost executor's rows
are drawn alike again.  All sums are of whole numbers, so a forest is the same on any
cluster.  The nodes are a table: saved, read and joined like any other.

Defined cases: rows without a date, id or time do not train; rows that repeat all of
``DRAW_KEYS`` are drawn together; a data set in which a tree draws no row has fewer trees;
a data set without rows has no model, and its predictions are null.  Times are whole minutes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftspark import constants as K
from shiftspark.functions import timeparts as T
from shiftspark.operators.features import add_features, encode_ids
from shiftspark.operators.forecast import HIST_END, HIST_START, REQUEST_COLS, mask_prediction, normalise_requests
from shiftspark.session import write_and_read

DATASET = "dataset_id"
DRAW_KEYS = [K.ID, K.DATE, K.START, K.END]
TARGETS = {"start": K.START, "end": K.END}
NODE = [DATASET, "target", "tree", "node"]
#: Bits of a node's number and of a feature's value (none is negative) where they share a long with others.
NODE_BITS, VALUE_BITS = 40, 32
#: Leaf values are whole millionths of a minute, so means over trees are exact too.
MICRO = 1_000_000
#: A draw of 32 bits counts once for each of these that it reaches: P(count <= k) of Poisson(1).
POISSON_STEPS = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]


@dataclass(frozen=True)
class ForestsParams:
    num_trees: int = K.N_TREES
    max_depth: int = K.MAX_DEPTH
    seed: int = K.SEED


def _features() -> Column:
    return F.array(*[F.col(c).cast("int") for c in K.FEATURES])


def draw(train: DataFrame, p: ForestsParams) -> DataFrame:
    """Every row once for each tree that draws it, with its count ``w``."""
    text = [F.col(c).cast("long" if c in TARGETS.values() else "string").cast("string") for c in DRAW_KEYS]

    def drawn(tree: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(p.seed)), tree.cast("string"), *text).cast("binary"))
        return F.struct(tree.alias("tree"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("u"))

    # The digest is part of what is exploded, so it is taken once a tree, not for each step that it is held against.
    rows = train.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(p.num_trees - 1)), drawn)).alias("_d"))
    count = reduce(lambda a, b: a + b, [(F.col("_d.u") >= t).cast("long") for t in POISSON_STEPS])
    return rows.select(*train.columns, "_d.tree", count.alias("w")).where("w > 0")


def node_splits(rows: DataFrame, may_split: bool) -> DataFrame:
    """The nodes at which ``rows`` (NODE, w, x, y) stand: n, value, and the best split.

    ``feature`` and ``threshold`` are null for a leaf: pure, or at the last level.  Rows
    whose value is at most the threshold, halfway between two values, go left.
    """
    sums = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")]
    if not may_split:
        # Nothing is looked for among the values, so there are no cells to shuffle.
        return rows.groupBy(*NODE).agg(*sums).select(
            *NODE, "n", F.expr(f"(s * {MICRO}L) div n").alias("value"),
            F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"))
    # Labels are the same for each feature: the last one's cells, of few values, carry their bounds.
    label = F.when(F.col("f") == len(K.FEATURES) - 1, F.col("y"))
    # Cells are many: target, tree and node go through the shuffles as one number, feature and value as another.
    target = F.array_position(F.array(*map(F.lit, TARGETS)), F.col("target")) - 1
    spot = F.shiftleft(F.col("tree") * F.lit(len(TARGETS)).cast("long") + target, NODE_BITS) + F.col("node")
    cells = (rows.select(DATASET, spot.alias("spot"), "w", "y", F.posexplode("x").alias("f", "v"))
             .groupBy(DATASET, "spot", (F.shiftleft(F.col("f").cast("long"), VALUE_BITS) + F.col("v")).alias("fv"))
             .agg(*sums, F.min(label).alias("lo"), F.max(label).alias("hi")))
    f = F.shiftright("fv", VALUE_BITS).cast("int")
    cells = cells.select(DATASET, "spot", f.alias("f"), (F.col("fv") - F.shiftleft(f.cast("long"), VALUE_BITS)).cast("int").alias("v"),
                         "n", "s", "lo", "hi")
    of = Window.partitionBy(DATASET, "spot", "f")
    line = of.orderBy("v")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = cells.select(DATASET, "spot", "f", "v", "lo", "hi", F.sum("n").over(of).alias("n"), F.sum("s").over(of).alias("s"),
                        F.sum("n").over(so_far).alias("nl"), F.sum("s").over(so_far).alias("sl"), F.lead("v").over(line).alias("next"))
    left, right = F.col("sl").cast("double"), (F.col("s") - F.col("sl")).cast("double")
    score = left * left / F.col("nl") + right * right / (F.col("n") - F.col("nl"))
    cut = F.struct(score.alias("score"), (-F.col("f")).alias("f"), (-(F.col("v") + F.col("next")) / 2.0).alias("t"))
    best = (cuts.groupBy(DATASET, "spot").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                              F.max(F.when(F.col("next").isNotNull(), cut)).alias("best")))
    tree = F.shiftright("spot", NODE_BITS)
    best = best.select("*", F.get(F.array(*map(F.lit, TARGETS)), (tree % len(TARGETS)).cast("int")).alias("target"),
                       F.floor(tree / len(TARGETS)).cast("int").alias("tree"),
                       F.col("spot").bitwiseAND(F.lit((1 << NODE_BITS) - 1)).alias("node"))
    splits = (F.col("lo") < F.col("hi")) & F.col("best").isNotNull()
    return best.select(*NODE, "n", F.expr(f"(s * {MICRO}L) div n").alias("value"),
                       F.when(splits, -F.col("best.f")).alias("feature"), F.when(splits, -F.col("best.t")).alias("threshold"))


def descend(rows: DataFrame, splits: DataFrame, stay: bool) -> DataFrame:
    """Rows one level down; rows of leaves ``stay`` where they are, or leave."""
    to = splits.where("feature IS NOT NULL").select(*NODE, "feature", "threshold")
    down = 2 * F.col("node") + (F.get("x", F.col("feature")) > F.col("threshold")).cast("long")
    return (rows.join(to, NODE, "left" if stay else "inner")
            .withColumn("node", F.coalesce(down, F.col("node"))).drop("feature", "threshold"))


def fit_forests(train: DataFrame, p: ForestsParams = ForestsParams()) -> DataFrame:
    """M3 + M4 of all data sets: the node table (NODE, level, n, value, feature, threshold).

    ``train``: ``dataset_id``, id, date, the features, start and end minutes.  Node 1 is the
    root, node k has the children 2k and 2k + 1.
    """
    whole = train.dropna(subset=[DATASET, *DRAW_KEYS]).select(DATASET, *DRAW_KEYS, _features().alias("x"))
    # An id's rows lie together, and stay so from level to level: most cells of its code are
    # whole before they are shuffled.  A hot id is split.
    drawn = draw(whole.hint("rebalance", DATASET, K.ID), p)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("long").alias("y")) for t, c in TARGETS.items()]))
    rows = (drawn.select(DATASET, "tree", "w", "x", each.alias("_t"))
            .select(DATASET, "_t.target", "tree", F.lit(1).cast("long").alias("node"), "w", "x", "_t.y"))
    rows, levels = write_and_read(rows, "forest-rows"), []
    for level in range(p.max_depth + 1):
        nodes = write_and_read(node_splits(rows, level < p.max_depth), "forest-nodes")
        levels.append(nodes.withColumn("level", F.lit(level)))
        if level == p.max_depth or nodes.where("feature IS NOT NULL").isEmpty():
            break
        rows = write_and_read(descend(rows, nodes, stay=False), "forest-rows")
    return write_and_read(reduce(DataFrame.unionByName, levels), "forests")


def predict(days: DataFrame, nodes: DataFrame, p: ForestsParams = ForestsParams()) -> DataFrame:
    """M5: distinct (dataset_id, id, date) of ``days`` with ``pred_start``, ``pred_end`` in minutes.

    ``days`` has ``id_encoded``.  Each day goes down every tree by the joins that grew it;
    leaf values are averaged over the trees that the data set has.
    """
    key = [DATASET, K.ID, K.DATE]
    distinct = days.select(*key, K.ID_ENCODED).dropDuplicates(key)
    rows = add_features(distinct).select(*key, _features().alias("x"))
    at = (rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(p.num_trees - 1))))
          .withColumn("target", F.explode(F.array(*map(F.lit, TARGETS)))).withColumn("node", F.lit(1).cast("long")))
    for level in range(p.max_depth):
        at = descend(at, nodes.where(F.col("level") == level), stay=True)
    found = at.join(nodes.select(*NODE, "value"), NODE, "left")

    sums = found.groupBy(*key).agg(*[a for t in TARGETS for a in (
        F.sum(F.when(F.col("target") == t, F.col("value"))).alias(f"s_{t}"),
        F.count(F.when(F.col("target") == t, F.col("value"))).alias(f"n_{t}"))])
    return sums.select(*key, *[(F.expr(f"s_{t} div n_{t}").cast("double") / MICRO).alias(f"pred_{t}") for t in TARGETS])


def forecast_by_dataset(requests: DataFrame, history: DataFrame, nodes: DataFrame, index: DataFrame,
                        p: ForestsParams = ForestsParams()) -> DataFrame:
    """M6 + M10: the forecast of each request from its own data set's records and forests.

    ``requests``: dataset_id and the request columns; ``history``: dataset_id, id, date, start,
    end; ``index``: dataset_id, id, id_encoded.  Ids that a data set does not know are not served.
    """
    request = [DATASET, *REQUEST_COLS]
    cal = (normalise_requests(requests).select(*request, F.explode(T.window_dates("target_date", "window_size")).alias(K.DATE))
           .join(index, [DATASET, K.ID]))
    key = [DATASET, K.ID, K.DATE]
    recorded = (history.join(cal.select(*key), key, "left_semi")
                .groupBy(*key).agg(F.max(F.struct(K.START, K.END)).alias("_p"))
                .select(*key, F.col(f"_p.{K.START}").alias(HIST_START), F.col(f"_p.{K.END}").alias(HIST_END)))
    frame = write_and_read(cal.join(recorded, key, "left").withColumn("historical", F.col(HIST_START).isNotNull()), "forecasts")
    guesses = predict(frame.where(~F.col("historical")), nodes, p)
    start, end = mask_prediction(F.col("pred_start"), F.col("pred_end"))
    hist = F.col("historical")
    return frame.join(guesses, key, "left").select(
        *request, F.col(K.DATE).alias("day"), T.display_date(K.DATE).alias("date"), T.weekday_name(K.DATE).alias("weekday"),
        F.when(hist, T.minutes_to_time(HIST_START)).otherwise(start).alias("start_time"),
        F.when(hist, T.minutes_to_time(HIST_END)).otherwise(end).alias("end_time"), "historical")


def backtest(history: DataFrame, index: DataFrame, first_days: int, step_days: int,
             p: ForestsParams = ForestsParams()) -> DataFrame:
    """Forecasts of recorded days from the days before a cut, beside a weekday mean.

    Cuts stand every ``step_days`` days, from ``first_days`` days after the first one.  Each cut
    is a data set of its own: all days before it train (so a row trains at every later cut),
    and the ``step_days`` days from it on are forecast.  One row a recorded day: ``horizon``
    (1 = the cut's day), ``known`` (the id has a day before the cut; else nothing is forecast),
    ``usable`` (the pair is no NA), and for start and end the recorded minutes, the
    forest's and the baseline's: the id's mean on that weekday, or on all days.
    """
    one = history.groupBy(K.ID, K.DATE).agg(F.max(F.struct(K.START, K.END)).alias("_p")).select(
        K.ID, K.DATE, F.col(f"_p.{K.START}").alias(K.START), F.col(f"_p.{K.END}").alias(K.END))
    one = write_and_read(encode_ids(one, index), "backtest-days")
    span = one.agg(F.date_add(F.min(K.DATE), first_days).alias("lo"), F.max(K.DATE).alias("hi"))
    cuts = F.when(F.col("lo") <= F.col("hi"), F.sequence("lo", "hi", F.expr(f"interval {step_days} days")))
    # One row, whose only value is the list of cuts.
    listed = span.select(cuts.alias("cuts")).scalar()
    days = one.select("*", F.explode(listed).alias("cut")).withColumn(DATASET, F.col("cut").cast("string"))
    before = days.where(F.col(K.DATE) < F.col("cut"))
    test = days.where((F.col(K.DATE) >= F.col("cut")) & (F.col(K.DATE) < F.date_add("cut", step_days)))
    nodes = fit_forests(add_features(before), p)

    weekday = T.day_of_week(K.DATE)

    def sums(tag: str) -> list[Column]:
        return [F.sum(F.col(c).cast("long") * MICRO).alias(f"{tag}_{t}") for t, c in TARGETS.items()]

    by_day = before.groupBy(DATASET, K.ID, weekday.alias("_wd")).agg(F.count("*").alias("n_day"), *sums("day"))
    by_id = before.groupBy(DATASET, K.ID).agg(F.count("*").alias("n_all"), *sums("all"))
    out = (test.withColumn("_wd", weekday).join(by_id, [DATASET, K.ID], "left").join(by_day, [DATASET, K.ID, "_wd"], "left"))
    known = out.where("n_all IS NOT NULL").select(DATASET, K.ID, K.DATE, K.ID_ENCODED)
    out = out.join(predict(known, nodes, p), [DATASET, K.ID, K.DATE], "left")
    na = mask_prediction(F.col("pred_start"), F.col("pred_end"))[0] == K.NA_VALUE
    base = [(F.expr(f"coalesce(day_{t} div n_day, all_{t} div n_all)").cast("double") / MICRO).alias(f"base_{t}") for t in TARGETS]
    return out.select("cut", K.ID, K.DATE, (F.datediff(K.DATE, "cut") + 1).alias("horizon"), F.col("n_all").isNotNull().alias("known"),
                      (F.col("n_all").isNotNull() & ~na).alias("usable"), K.START, K.END, "pred_start", "pred_end", *base)


def backtest_errors(rows: DataFrame, *by: str) -> DataFrame:
    """Mean absolute errors in minutes of a backtest's usable forecasts, and of the baseline on
    the same days, for each value of ``by``; days not forecast and NA pairs are counted."""
    def error(guess: str, label: str) -> Column:
        return F.avg(F.when(F.col("usable"), F.abs(F.col(guess) - F.col(label))))

    return rows.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.count_if(~F.col("known")).alias("n_unknown"),
        F.count_if(F.col("known") & ~F.col("usable")).alias("n_na"),
        *[error(f"{g}_{t}", c).alias(f"{name}_error_{t}") for name, g in (("model", "pred"), ("baseline", "base"))
          for t, c in TARGETS.items()])
