"""Grouped statistics, metrics, fills by group means and block down-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_statistics(df: DataFrame, keys: Sequence[str], value: str, population: bool = False) -> DataFrame:
    """n, mean and spread of each band, nulls left out; groups of fewer than two readings are left out."""
    spread = F.stddev_pop if population else F.stddev_samp
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), spread(value).alias("std")).where("n >= 2")


def merge_means(df: DataFrame, keys: Sequence[str], mean: str, weight: str) -> DataFrame:
    """The mean that running averages (mean, weight) make together."""
    return df.groupBy(*keys).agg((F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def block_down_sample(df: DataFrame, keys: Sequence[str], value: str, height: int, width: int, nodata: float | None = None) -> DataFrame:
    """Means of blocks of height x width pixels, and whether all of a block is valid. With `nodata`, nulls count as that number."""
    v = F.col(value) if nodata is None else F.coalesce(F.col(value), F.lit(nodata))
    block = [F.floor(F.col("y") / height).alias("by"), F.floor(F.col("x") / width).alias("bx")]
    return df.groupBy(*keys, *block).agg(F.avg(v).alias("mean"), F.bool_and(F.col(value).isNotNull()).alias("valid"), F.max(F.col(value).isNull().cast("int")).alias("mask"))


def group_mask(df: DataFrame, groups: DataFrame, keys: Sequence[str], band: str, value: str) -> DataFrame:
    """A channel group is masked if any of its bands is. groups: (band, group), a registry of a fixed size."""
    return df.join(F.broadcast(groups), band).groupBy(*keys, "group").agg(F.bool_or(F.col(value).isNull()).alias("masked"))


def fill_by_step_means(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """Fill of each band: the mean over steps of the mean of each step; a step without readings counts as zero."""
    steps = df.groupBy(*keys, step).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("step_mean"))
    return steps.groupBy(*keys).agg(F.avg("step_mean").alias("fill"))


def first_valid(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Of each target pixel's readings the first valid one in the order given. Rows are reduced before they are shuffled."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def best_overpass(df: DataFrame, keys: Sequence[str], overpass: str, value: str) -> DataFrame:
    """The overpass with most valid pixels; equal ones by name."""
    counts = df.groupBy(*keys, overpass).agg(F.count(value).alias("n_valid"))
    return counts.groupBy(*keys).agg(F.min_by(overpass, F.struct((-F.col("n_valid")).alias("n"), F.col(overpass))).alias(overpass), F.max("n_valid").alias("n_valid"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bins: int = 4096) -> DataFrame:
    """Exact percentiles, between two readings by their distance, of groups that may hold most of all rows: (*keys, p0, p1, ..), one column for each share.

    Readings are counted in bins between a group's ends first. Only those in the bins
    that the percentiles lie in are then counted by value and ranked, so no task sees a
    whole group unless its readings are few or nearly all alike.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0))  # null keys are equal inside of it
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    bin_of = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))
    placed = rows.join(ends, "_g").select("_g", "_v", "_n", bin_of.alias("_bin"))
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    held = placed.groupBy("_g", "_bin").agg(F.count(F.lit(1)).alias("_in"), F.first("_n").alias("_n"))
    held = held.withColumn("_before", F.sum("_in").over(up_to("_g", "_bin")) - F.col("_in"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * s), F.ceil((F.col("_n") - 1) * s)) for s in shares])))
    held = held.select("_g", "_bin", "_before", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_in"))).alias("_ranks")).where(F.size("_ranks") > 0)
    counted = placed.join(held.select("_g", "_bin"), ["_g", "_bin"], "left_semi").groupBy("_g", "_bin", "_v").agg(F.count(F.lit(1)).alias("_times"))
    counted = counted.withColumn("_upto", F.sum("_times").over(up_to("_g", "_bin", "_v")))
    found = counted.join(held, ["_g", "_bin"]).withColumn("_stop", F.col("_before") + F.col("_upto"))
    found = found.select("_g", "_v", F.explode(F.filter("_ranks", lambda r: (r < F.col("_stop")) & (r >= F.col("_stop") - F.col("_times")))).alias("_rank"))
    listed = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two for each share
    listed = listed.join(ends.select("_g", (F.col("_n") - 1).alias("_last")), "_g")

    def between(share: float) -> Column:
        place = F.col("_last") * share
        low, high = F.element_at("_at", F.floor(place)), F.element_at("_at", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return listed.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *[between(s).alias(f"p{k}") for k, s in enumerate(shares)])


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """n, RMSE, R2, mean and median absolute error of each group. few_groups: the groups are large, so their medians are found in bins."""
    e = F.col(label) - F.col(prediction)
    both = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    sums = [F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("se"), (F.var_pop(label) * F.count(F.lit(1))).alias("st"), F.avg(F.abs(e)).alias("mae")]
    if few_groups:
        medians = percentiles(both.withColumn("_e", F.abs(e)), keys, "_e", [0.5]).withColumnRenamed("p0", "median_ae")
        grouped = both.groupBy(*keys).agg(*sums).join(medians, list(keys)) if keys else both.agg(*sums).join(medians)  # one row each
    else:
        grouped = both.groupBy(*keys).agg(*sums, F.percentile(F.abs(e), 0.5).alias("median_ae"))
    return grouped.select(*keys, "n", F.sqrt(F.col("se") / F.col("n")).alias("rmse"), (1 - F.col("se") / F.nullif(F.col("st"), F.lit(0.0))).alias("r2"), "mae", "median_ae")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """support, predicted, hits, precision, recall, F1 and IoU of every class of a confusion matrix."""
    rows = matrix.select("label", F.col("prediction"), "n")
    sides = rows.select(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.unionByName(rows.select(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    union = F.col("support") + F.col("predicted") - F.col("hits")
    return sums.select("*", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), F.when(union > 0, F.col("hits") / (union + 1e-8)).alias("iou"))


def classification_metrics(scores: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 weighted by support, mean IoU over classes that occur."""
    s = F.col("support")
    weighted = lambda c: F.sum(F.col(c) * s) / F.sum(s)
    return scores.agg((F.sum("hits") / F.sum(s)).alias("accuracy"), F.avg(F.when(s > 0, F.col("recall"))).alias("balanced_accuracy"), weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), F.avg("iou").alias("mean_iou"))


def metric_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Metrics of the model, of an all-zero baseline, and over labels strictly between 0 and 1, in one pass."""
    y = F.col(label)
    variant = lambda name, p, use: F.struct(F.lit(name).alias("variant"), p.alias("p"), use.alias("use"))
    variants = F.array(variant("model", F.col(prediction), F.lit(True)), variant("zero", F.lit(0.0), F.lit(True)), variant("inner", F.col(prediction), (y > 0) & (y < 1)))
    return regression_metrics(df.select(y.alias("y"), F.explode(variants).alias("v")).select("y", "v.*").where("use"), "y", "p", ["variant"], few_groups=True)


def with_pooled(df: DataFrame, sample: str, label: str, prediction: str) -> DataFrame:
    """RMSE of every sample and, under a null sample, of all pixels together."""
    e = F.col(label) - F.col(prediction)
    return df.rollup(sample).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(e * e) / F.count(F.lit(1))).alias("rmse"))


def masked_losses(df: DataFrame, mask: str, label: str, prediction: str) -> DataFrame:
    """Squared and smooth-L1 loss over the positions to decode (mask 2)."""
    d = F.abs(F.col(label) - F.col(prediction))
    return df.where(F.col(mask) == 2).agg(F.avg(d * d).alias("mse"), F.avg(F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)).alias("smooth_l1"), F.count(F.lit(1)).alias("n"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean of vectors by position, as (keys, pos, mean)."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("mean"))


def parity(df: DataFrame, ours: str, theirs: str, keys: Sequence[str], least: int = 4) -> DataFrame:
    """Median absolute difference and correlation where both are valid; null under `least` pairs."""
    both = df.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    enough = F.count(F.lit(1)) >= least
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(enough, F.percentile(F.abs(F.col(ours) - F.col(theirs)), 0.5)).alias("median_diff"), F.when(enough, F.corr(ours, theirs)).alias("corr"))


def histogram(df: DataFrame, band: str, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between each band's least and greatest reading; the greatest is in the last bin."""
    ends = df.groupBy(band).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    k = F.least(F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).join(ends, band).groupBy(band, F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lower_median(value: str) -> Column:
    """The middle reading, the lower one of two; nulls are left out."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)")


def fractional_cover(df: DataFrame, keys: Sequence[str], code: str, wanted: int) -> DataFrame:
    """Share of each cell's pixels that have a class."""
    return df.groupBy(*keys).agg(F.avg((F.col(code) == wanted).cast("double")).alias("cover"))


def clip_actions(pixels: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """What becomes of each clipped raster: SKIP_EMPTY without valid pixels, SKIP_PARTIAL under `least`, else CLIP; and their number."""
    n = F.count(value)
    return pixels.groupBy(*keys).agg(F.when(n == 0, "SKIP_EMPTY").when(n < least, "SKIP_PARTIAL").otherwise("CLIP").alias("action"), n.alias("valid_pixel_count"))


def action_tally(actions: DataFrame, source: str, action: str, pixels: str) -> DataFrame:
    """Rasters and valid pixels of each action of each source, of each source, and of all (nulls stand for all)."""
    return actions.rollup(source, action).agg(F.count(F.lit(1)).alias("n"), F.sum(pixels).alias("valid_pixels"))


def unmasked_samples(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Samples with at least one reading, and the number of their pixels."""
    return df.groupBy(*keys).agg(F.count(value).alias("_valid"), F.count(F.lit(1)).alias("n")).where("_valid > 0").drop("_valid")


def coverage(df: DataFrame, day: str, place: Sequence[str], value: str) -> DataFrame:
    """Share of all places that have a valid reading on each day. The places are those that occur on any day."""
    places = df.select(*place).distinct().agg(F.count(F.lit(1)).alias("_places"))  # one row
    valid = df.where(F.col(value).isNotNull()).select(day, *place).distinct().groupBy(day).agg(F.count(F.lit(1)).alias("_valid"))
    every = df.select(day).distinct().join(valid, day, "left").join(F.broadcast(places))
    return every.select(day, (F.coalesce("_valid", F.lit(0)) / F.col("_places")).alias("coverage"))


def band_availability(df: DataFrame, keys: Sequence[str], value: str, cell: str) -> DataFrame:
    """Whether each band has any reading at each step, and how many cells it has."""
    return df.groupBy(*keys).agg(F.bool_or(F.col(value).isNotNull()).alias("available"), F.countDistinct(cell).alias("n_cells"))


def calendar_histogram(df: DataFrame, day: str) -> DataFrame:
    """Scenes of each year and month."""
    return df.groupBy(F.year(day).alias("y"), F.month(day).alias("m")).agg(F.count(F.lit(1)).alias("n"))


def day_shifted(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Accumulated readings, each of the day before: null where that day has none."""
    moved = df.select(*keys, F.date_add(day, 1).alias(day), value)
    return df.select(*keys, day).distinct().join(moved, [*keys, day], "left")


def band_magnitude(df: DataFrame, band: str, value: str, cloudy: Column, shares: Sequence[float]) -> DataFrame:
    """How much brighter a band is under clouds: the ratio of percentiles of cloudy and clear readings, r0, r1, .. for each share."""
    rows = df.select(band, cloudy.alias("_cloudy"), value).where("_cloudy is not null")
    found = percentiles(rows, [band, "_cloudy"], value, shares)
    both = [found.where(c).select(band, *[F.col(f"p{k}").alias(f"{n}{k}") for k in range(len(shares))]) for c, n in (("_cloudy", "a"), ("not _cloudy", "b"))]
    return both[0].join(both[1], band, "full").select(band, *[(F.col(f"a{k}") / F.nullif(F.col(f"b{k}"), F.lit(0.0))).alias(f"r{k}") for k in range(len(shares))])


def extent_union(df: DataFrame, x: str, y: str, kind: str) -> DataFrame:
    """The box around all cells, and how many kinds of cells there are (one, if the grid is uniform)."""
    return df.agg(F.min(x).alias("min_lon"), F.min(y).alias("min_lat"), F.max(x).alias("max_lon"), F.max(y).alias("max_lat"), F.countDistinct(kind).alias("kinds"))


def label_sets(df: DataFrame, day: str, label: str) -> DataFrame:
    """The distinct labels of each prediction day, in order."""
    return df.groupBy(day).agg(F.concat_ws(",", F.array_sort(F.collect_set(label))).alias("bands"))


def zero_signal(df: DataFrame, keys: Sequence[str], value: str, axis: str, least: int, reach: int) -> DataFrame:
    """Rasters with fewer valid pixels than `least`, or whose valid pixels do not go as far as `reach` along an axis."""
    facts = df.groupBy(*keys).agg(F.count(value).alias("n_valid"), F.max(F.when(F.col(value).isNotNull(), F.col(axis))).alias("reach"))
    return facts.where((F.col("n_valid") < least) | (F.coalesce("reach", F.lit(-1)) < reach))


def unreal_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many readings of each group are missing, not a number or infinite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return df.groupBy(*keys).agg(F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("n"))


def extent_kinds(df: DataFrame, keys: Sequence[str], value: str, expected: int, least: float = 0.25) -> DataFrame:
    """Whether each raster is missing, truncated or present, by its valid share of the expected pixels."""
    n = F.count(value)
    return df.groupBy(*keys).agg(F.when(n == 0, "missing").when(n / expected >= least, "present").otherwise("truncated").alias("kind"))
