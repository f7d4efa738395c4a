"""Questionnaire scoring, positions, comparison, credibility scores. Arithmetic on columns and grouped tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spread of an item, mean correlation, points for each unit of theta.
SD_ITEM, R_BAR = 1.15, 0.45
LAMBDA = SD_ITEM * R_BAR**0.5
MIN_ITEMS, MIN_COVERAGE, MIDPOINT = 2, 0.60, 3.0


def keyed_value(value: Column, direction: Column, is_dk: Column) -> Column:
    return F.when(~is_dk, F.when(direction > 0, value).otherwise(6 - value))


def reliability(k: Column) -> Column:
    """Spearman-Brown, 0 to 0.99."""
    return F.when(k > 0, F.least(F.lit(0.99), k * R_BAR / (1 + (k - 1) * R_BAR))).otherwise(0.0)


def sem(k: Column) -> Column:
    rel = reliability(k)
    return F.sqrt(F.greatest(F.lit(0.0), (1 - rel) / rel))


def margin(k: Column) -> Column:
    return F.lit(LAMBDA) * sem(k)


def normal_cdf(z: Column) -> Column:
    """By Abramowitz and Stegun's formula 7.1.26 for erf."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return 0.5 * (1 + F.signum(z) * (1 - poly * t * F.exp(-x * x)))


def clarity(theta: Column, s: Column) -> Column:
    z = F.abs(theta) / F.greatest(F.lit(1e-6), s)
    return F.when(theta.isNull() | s.isNull(), "unknown").when(z < 1, "middle").when(z < 2, "lean").otherwise("clear")


def axis_scores(responses: DataFrame, items: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(respondent_id, axis_id, k, status, score, theta, sem, margin, percentile, clarity).

    responses: (respondent_id, item_id, value, is_dk); items: (item_id, axis_id, direction), a dimension. An axis needs two
    answers and three fifths of the items shown (shown: respondent_id, axis_id, n; else all that were answered or passed).
    """
    rows = responses.join(items, "item_id").withColumn("v", keyed_value(F.col("value"), F.col("direction"), F.col("is_dk")))
    out = rows.groupBy("respondent_id", "axis_id").agg(F.count("v").alias("k"), F.sum("v").alias("total"), F.count("*").alias("n_shown"))
    if shown is not None:
        out = out.drop("n_shown").join(shown.withColumnRenamed("n", "n_shown"), ["respondent_id", "axis_id"], "left").na.fill({"n_shown": MIN_ITEMS})
    ok = (F.col("k") >= MIN_ITEMS) & (F.col("k") / F.greatest(F.lit(1), F.col("n_shown")) >= MIN_COVERAGE)
    out = out.withColumn("status", F.when(ok, "ok").otherwise("insufficient")).withColumn("score", F.when(ok, F.col("total") / F.col("k")))
    out = out.withColumn("theta", (F.col("score") - MIDPOINT) / LAMBDA).withColumn("sem", F.when(ok, sem(F.col("k"))))
    return out.select("respondent_id", "axis_id", "k", "status", "score", "theta", "sem", (F.col("sem") * LAMBDA).alias("margin"), (100 * normal_cdf(F.col("theta"))).alias("percentile"), clarity(F.col("theta"), F.col("sem")).alias("clarity"))


def coherence(scores: DataFrame, corr: DataFrame) -> DataFrame:
    """(respondent_id, axes_scored, tension_share): share of axis pairs whose signs go against their correlation.

    corr: (ax_i, ax_j, r), 45 rows, looked up by axis.
    """
    ok = scores.where("status = 'ok'").select("respondent_id", "axis_id", "theta")
    pairs = ok.withColumnsRenamed({"axis_id": "ax_i", "theta": "ti"}).join(ok.withColumnsRenamed({"axis_id": "ax_j", "theta": "tj"}), "respondent_id").where("ax_i < ax_j").join(corr, ["ax_i", "ax_j"])
    share = pairs.groupBy("respondent_id").agg(F.avg(F.when(F.col("r") * F.col("ti") * F.col("tj") < 0, 1.0).otherwise(0.0)).alias("tension_share"))
    return ok.groupBy("respondent_id").agg(F.count("*").alias("axes_scored")).join(share, "respondent_id", "left").na.fill(0.0)


def most_decided(scores: DataFrame, top: int = 3, closest: bool = False) -> DataFrame:
    """The axes farthest from (or closest to) the middle."""
    w = Window.partitionBy("respondent_id").orderBy(F.abs("theta").asc() if closest else F.abs("theta").desc(), "axis_id")
    return scores.where("status = 'ok'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def upper_median(c: Column) -> Column:
    """Aggregate: the value at floor(n / 2) of the sorted ones."""
    return F.element_at(F.array_sort(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def quality_flags(responses: DataFrame, attention_item: str | None = None) -> DataFrame:
    """(respondent_id, dk_share, flags): too many "don't know", one answer all over, too fast, attention failed."""
    usual = responses.where(F.col("item_id") != attention_item) if attention_item else responses
    modal = usual.where("not is_dk").groupBy("respondent_id", "value").count().groupBy("respondent_id").agg(F.max("count").alias("top"))
    base = usual.groupBy("respondent_id").agg(F.count("*").alias("n"), F.count_if(~F.col("is_dk")).alias("numeric"), upper_median(F.col("seconds")).alias("median"))
    base = base.join(modal, "respondent_id", "left")
    if attention_item:
        failed = responses.where(F.col("item_id") == attention_item).groupBy("respondent_id").agg(F.max(F.col("value") != 2).alias("failed"))
        base = base.join(failed, "respondent_id", "left")
    else:
        base = base.withColumn("failed", F.lit(False))
    dk = 1 - F.col("numeric") / F.col("n")
    flags = F.array_compact(F.array(F.when(dk > 0.25, "dk"), F.when((F.col("numeric") >= 6) & (F.col("top") / F.col("numeric") >= 0.6), "flat"), F.when(F.col("median") < 2.5, "fast"), F.when(F.coalesce("failed", F.lit(False)), "attention")))
    return base.select("respondent_id", dk.alias("dk_share"), flags.alias("flags"))


def focus_order(weights: DataFrame) -> DataFrame:
    """weights (respondent_id, axis_id, axis_no, weight, margin) with rank: weight times margin (1 and 1.2 where unknown), largest first."""
    value = F.coalesce("weight", F.lit(1.0)) * F.coalesce("margin", F.lit(1.2))
    return weights.withColumn("rank", F.row_number().over(Window.partitionBy("respondent_id").orderBy(value.desc(), "axis_no")))


def next_items(order: DataFrame, items: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(respondent_id, item_id, nth): the next n items, axis by axis in focus order, poles in turn, three of each at most.

    items: (item_id, axis_id, direction, item_no), a dimension.
    """
    pool = order.select("respondent_id", "axis_id", "rank").join(items, "axis_id").join(asked.select("respondent_id", "item_id"), ["respondent_id", "item_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("respondent_id", "axis_id", "direction").orderBy("item_no"))
    pool = pool.withColumn("r", nth).where("r <= 3").withColumn("slot", 2 * F.col("r") - F.when(F.col("direction") > 0, 1).otherwise(0))
    return pool.withColumn("nth", F.row_number().over(Window.partitionBy("respondent_id").orderBy("rank", "slot"))).where(F.col("nth") <= n).select("respondent_id", "item_id", "nth")


def site_position(score: Column) -> Column:
    """0 to 100; null without a score."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), ((6 - score) - 1) * 25)))


def score_to_position(score: Column) -> Column:
    return (score - 1) * 25


def position_to_score(position: Column) -> Column:
    return position / 25 + 1


def leaning(positions: DataFrame, identity: str = "identity", economy: str = "economy") -> DataFrame:
    """(subject_id, leaning): from the identity and economy axes; null if either is missing."""
    at = lambda axis: F.max(F.when(F.col("axis_id") == axis, F.col("value")))
    return positions.groupBy("subject_id").agg(F.round(((100 - at(identity)) + at(economy)) / 2).alias("leaning"))


def pole_of(value: Column, left: Column, right: Column) -> Column:
    return F.when(value < 45, left).when(value > 55, right)


#: Subjects of a catalogue that a task holds at a time.
BLOCK_SUBJECTS = 50_000


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """(name, axes, values): a subject's positions as arrays; it has one for each axis."""
    told = rows.where("value is not null").groupBy(F.col("subject_id").alias(name)).agg(F.array_sort(F.collect_list(F.struct("axis_id", F.col("value").cast("double").alias("value")))).alias("x"))
    return told.select(name, F.transform("x", lambda r: r["axis_id"]).alias("axes"), F.transform("x", lambda r: r["value"]).alias("values"))


def _matrix(axes: list, values: list, known: dict) -> np.ndarray:
    """Subjects by axes, with gaps where a subject has no position; axes that the catalogue lacks are left out."""
    out = np.full((len(axes), len(known)), np.nan)
    at = [(k, known[a], v) for k, (own, told) in enumerate(zip(axes, values, strict=True)) for a, v in zip(own, told, strict=True) if a in known]
    if at:
        rows, columns, found = zip(*at, strict=True)
        out[rows, columns] = found
    return out


def _meet(a: DataFrame, b: DataFrame, least: int, top: int | None, block: int) -> DataFrame:
    """(a_id, b_id, compared, total, n_major) of all pairs with at least `least` axes in common, or of the `top` likest of each a in each block of b.

    A subject's positions are one array. The catalogue b goes in blocks, as packed matrices, to every part of a; a part's subjects
    stream past a block, so a task holds a block and a batch, and nothing is shuffled by axis.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = _gathered(a, "a_id"), _gathered(b, "b_id")
    blocks = max(1, -(-right.count() // block))
    kinds = {"a_id": left.schema["a_id"].dataType, "b_id": right.schema["b_id"].dataType}
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = left.select(F.pmod(F.xxhash64("a_id"), F.lit(n)).cast("int").alias("part"), every.alias("block"), F.lit(1).alias("asks"), "a_id", none("b_id"), "axes", "values")
    held = right.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.pmod(F.xxhash64("b_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), none("a_id"), "b_id", "axes", "values")
    both = held.unionByName(asks).repartition(n, "part", "block").sortWithinPartitions("part", "block", "asks", "b_id")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, ids, axes, values, known, packed = None, [], [], [], {}, None
        for batch in batches:
            part, which, ask, a_ids, b_ids, own_axes, own = (batch.column(k).to_pylist() for k in range(7))
            lo = 0
            while lo < batch.num_rows:
                hi, key = lo, (part[lo], which[lo])
                while hi < batch.num_rows and (part[hi], which[hi]) == key and ask[hi] == ask[lo] and hi - lo < 256:
                    hi += 1
                if key != at:
                    at, ids, axes, values, packed = key, [], [], [], None
                if not ask[lo]:
                    ids, axes, values, packed = ids + b_ids[lo:hi], axes + own_axes[lo:hi], values + own[lo:hi], None
                elif ids:
                    if packed is None:
                        known = {x: k for k, x in enumerate(sorted({x for told in axes for x in told}))}
                        packed = _matrix(axes, values, known)
                    gap = np.abs(_matrix(own_axes[lo:hi], own[lo:hi], known)[:, None, :] - packed[None])
                    compared, total, major = (~np.isnan(gap)).sum(2), np.nansum(gap, 2), (gap >= 30).sum(2)
                    x, y = np.nonzero(compared >= least)
                    if top is not None:
                        likeness = np.floor(np.floor((100 - total / np.maximum(compared, 1)) * 1e4 + 0.5) / 1e4 + 0.5)
                        order = np.lexsort((y, -likeness[x, y], x))
                        x, y = x[order], y[order]
                        first = np.arange(len(x)) - np.searchsorted(x, x) < top
                        x, y = x[first], y[first]
                    yield pa.RecordBatch.from_arrays([pa.array([a_ids[lo + k] for k in x], batch.schema.field(3).type), pa.array([ids[k] for k in y], batch.schema.field(4).type), pa.array(compared[x, y], pa.int64()), pa.array(total[x, y], pa.float64()), pa.array(major[x, y], pa.int64())], names=["a_id", "b_id", "compared", "total", "n_major"])
                lo = hi

    found = both.mapInArrow(compare, f"a_id {kinds['a_id'].simpleString()}, b_id {kinds['b_id'].simpleString()}, compared long, total double, n_major long")
    match = F.round((100 - F.col("total") / F.col("compared")).cast("decimal(12,4)")).cast("double")
    return found.select("a_id", "b_id", "compared", match.alias("match"), "n_major")


def compare_positions(a: DataFrame, b: DataFrame, least: int = 1, block: int = BLOCK_SUBJECTS) -> DataFrame:
    """(a_id, b_id, compared, match, n_major): likeness on the axes that both have. a, b: (subject_id, axis_id, value), an axis of a
    subject once. b is a catalogue; it goes to all parts of a in blocks. Null values are gaps; pairs without an axis in common go."""
    return _meet(a, b, max(least, 1), None, block)


def top_matches(a: DataFrame, b: DataFrame, top: int, least: int = 3, block: int = BLOCK_SUBJECTS) -> DataFrame:
    """(a_id, b_id, compared, match, n_major, rank): the `top` likest of the catalogue for each a, by b_id among equals. Each block keeps
    no more than that of a subject, so pairs aren't written out."""
    return rank_matches(_meet(a, b, least, top, block), least).where(F.col("rank") <= top)


def rank_matches(compared: DataFrame, least: int = 3) -> DataFrame:
    w = Window.partitionBy("a_id").orderBy(F.col("match").desc(), "b_id")
    return compared.where(F.col("compared") >= least).withColumn("rank", F.row_number().over(w))


def chunk_ratio(u: Column, s: Column) -> Column:
    return F.when(s > 0, u / s)


def worst_percentile(u: str, s: str, share: float = 0.15) -> Column:
    """Aggregate: the ratio at that share of the sorted ones."""
    return F.expr(f"percentile_disc({share}) within group (order by case when {s} > 0 then {u} / {s} end)")


def promise_average(value: Column) -> Column:
    """Aggregate: the mean of values on the scale; null without any."""
    return F.avg(F.when(value.isin(0.0, 0.25, 0.5, 0.75, 1.0), value))


def credibility_1_10(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.round(score.cast("decimal(18,9)") * 10).cast("int"))))


def final_scores(chunks: DataFrame, promises: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(entity_id, promise_mean, worst, truth_score, credibility, band); a given score wins. chunks: (entity_id, u, s); promises: (entity_id, value)."""
    left = chunks.groupBy("entity_id").agg(worst_percentile("u", "s").alias("worst"))
    out = left.join(promises.groupBy("entity_id").agg(promise_average(F.col("value")).alias("promise_mean")), "entity_id", "full")
    own = F.col("promise_mean") * F.col("worst")
    if given is not None:
        out = out.join(given, "entity_id", "left")
        own = F.coalesce(F.col("given"), own)
    out = out.withColumn("truth_score", own).withColumn("credibility", credibility_1_10(F.col("truth_score")))
    return out.select("entity_id", "promise_mean", "worst", "truth_score", "credibility", credibility_band(F.col("credibility")).alias("band"))


def credibility_band(score: Column) -> Column:
    return F.when(score >= 7, "green").when(score >= 4.5, "amber").when(score.isNotNull(), "red")
