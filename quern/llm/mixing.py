"""Mixing sources to target weights by entropy balancing.

Each source's target is a number of words. Among all document rates between 0 and `most` that take the target,
entropy balancing picks those closest to equal rates; they are tilted exponentially by the document's size:
rate / (most - rate) = exp(tilt * size). The tilt solves a convex dual with one unknown for each source, by
Newton's method, whose sums Spark takes over all documents. Rates then become whole copies: a document's hash
stands for its place between two whole numbers, and one shift for each source makes the copies' words meet the target.

Null or empty texts have size 0 and are taken 0 or 1 times like others, for 0 words. A null source is one source, the
last one. Rows that share a key, null keys too, have places of their own, by their turn among equal rows; so a source of
one repeated key meets its target like any other, and reruns take as many copies of equal rows. Sums, not
the search for the tilt, decide the last copies: a source whose search has not ended after STEPS still meets its target. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE_RUN, stored

#: Steps of the search for the tilt, and how near to the target they must come.
STEPS, NEAR = 40, 1e-9
#: Places of the rounding shift between -1 and 1, and how many of them make a coarse one.
PLACES, COARSE = 1 << 16, 1 << 8
#: Bounds of the size classes that are rounded one after the other, as parts of the source's mean size.
LEVELS = (0.25, 1.0, 4.0)


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    ends = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    return F.greatest(F.size(parts).cast("long") - ends, F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(src, src_null, source_size, target) of each source.

    Weights go to sources in code point order, null last, and repeat. They share `share` times all words; no target is
    above `most` times its source's words, and what is cut there is shared again by weight among the others.
    """
    sums = sized.groupBy("src", "src_null").agg(F.sum("size").alias("source_size"))
    # one row for each source from here on
    place = F.row_number().over(Window.orderBy("src_null", "src")) - 1
    listed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * float(share))
    filling = Window.orderBy((F.col("cap") / F.col("weight")), "src_null", "src")
    listed = listed.withColumn("cut", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    listed = listed.withColumn("level", (F.col("total") - F.col("cut")) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    listed = listed.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy()))
    return listed.select("src", "src_null", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def tilted(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """targets with the column `tilt`; null where every document is taken `most` times."""
    same = ["src", "src_null"]
    open_ = (F.col("target") < F.col("source_size") * float(most)) & (F.col("source_size") > 0)
    state = targets.select(*same, "source_size", "target", F.when(open_, 0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (~open_).alias("done"))
    state = stored(state, "tilt")
    means = stored(hist.groupBy(*same).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")), "mean")
    for _ in range(STEPS):
        z = F.try_divide(F.col("size"), F.col("mean"))
        rate = float(most) / (1 + F.exp(-F.col("tilt") * z))
        slope = rate * (1 - rate / float(most)) * z
        sums = (
            hist.join(means, same).join(state.where("not done").select(*same, "tilt"), same)
            .groupBy(*same).agg(F.sum(F.col("n") * F.col("size") * rate).alias("taken"), F.sum(F.col("n") * F.col("size") * slope).alias("slope"))
        )
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        # a step out of the known bounds, or one without slope, becomes one to the middle or outwards
        middle = F.when(F.col("new_low").isNull(), F.col("new_high") * 2 - 1).when(F.col("new_high").isNull(), F.col("new_low") * 2 + 1).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        fits = F.coalesce((F.col("newton") > F.col("new_low")) | F.col("new_low").isNull(), F.lit(False)) & F.coalesce((F.col("newton") < F.col("new_high")) | F.col("new_high").isNull(), F.lit(False)) & F.coalesce(F.abs(F.col("newton") - F.col("tilt")) < 1000, F.lit(False))
        stepped = state.join(sums, same, "left").select(
            *same, "source_size", "target", "tilt", "done", low.alias("new_low"), high.alias("new_high"), F.when(F.col("slope") > 0, newton).alias("newton"),
            (F.col("done") | F.coalesce(F.abs(gap) <= NEAR * F.col("target"), F.lit(True))).alias("near"),
        )
        state = stored(stepped.select(*same, "source_size", "target", F.when(F.col("near"), F.col("tilt")).otherwise(F.when(fits, F.col("newton")).otherwise(middle)).alias("tilt"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("near").alias("done")), "tilt")
        if not state.where("not done").limit(1).count():
            break
    return state.join(means, same).select(*same, "source_size", "target", "tilt", "mean")


def _rate(most: float) -> Column:
    """Rounded, as are the gaps of the rounding shifts, so that the order of a sum's additions decides nothing."""
    tilted_rate = float(most) / (1 + F.exp(-F.col("tilt") * F.try_divide(F.col("size"), F.col("mean"))))
    even = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    return F.round(F.when(F.col("tilt").isNull(), even).otherwise(tilted_rate), 12)


def _place() -> Column:
    """Where between -1 and 1 the shift must stand for one more copy, as a whole number of places. The hash passes over a null `at`."""
    u = F.shiftrightunsigned(F.xxhash64("key", "at"), 11) * F.lit(2.0**-53)
    return F.floor((u - (F.col("rate") - F.floor("rate")) + 1) * (PLACES / 2)).cast("long")


def _level() -> Column:
    """Size classes by the source's mean: rounding begins with the largest documents and ends with the smallest."""
    return sum(((F.col("size") > F.col("mean") * m).cast("int") for m in LEVELS), F.lit(0))


def _turns(sized: DataFrame) -> DataFrame | None:
    """(_at, at) of the rows whose key repeats: their number among rows of equal key, source and size; None if no key repeats.

    Numbers are given within the parts that rows were written in, behind the counts of earlier parts, so that the
    rows of one key do not meet in one task.
    """
    often = stored(sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key")), "often")
    if often.isEmpty():
        return None
    rows = sized.join(often, F.col("key").eqNullSafe(F.col("_key")), "left_semi").select("_at", "_part", F.xxhash64("key", "src", "src_null", "size").alias("g"))
    counts = rows.groupBy("g", "_part").agg(F.count("*").alias("n"))
    ahead = counts.select("g", "_part", (F.sum("n").over(Window.partitionBy("g").orderBy("_part")) - F.col("n")).alias("ahead"))
    turn = F.row_number().over(Window.partitionBy("g", "_part").orderBy("_at"))
    return stored(rows.withColumn("turn", turn).join(ahead, ["g", "_part"]).select("_at", (F.col("ahead") + F.col("turn")).alias("at")), "turns")


def _sized(key: str, text: str, source: str) -> list[Column]:
    place = [F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part")]
    return [F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(source).isNull().alias("src_null"), word_count(F.col(text)).alias("size"), *place]


def _with_turns(rows: DataFrame, turns: DataFrame | None) -> DataFrame:
    found = rows.withColumn("at", F.lit(None).cast("long")) if turns is None else rows.join(turns, "_at", "left")
    return found.drop("_at", "_part")


def mixing_plan(docs: DataFrame, weights: list[float], share: float, most: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, rate, copies) of each row; copies are 0 to `most`."""
    sized = stored(docs.select(*_sized(key, text, source)), "sizes")
    turns = _turns(sized)
    sized = _with_turns(sized, turns) if turns is None else stored(_with_turns(sized, turns), "sizes")
    params = mixing_params(sized, weights, share, most)
    return with_copies(sized, params, most).select(F.col("key").alias(key), F.when(~F.col("src_null"), F.col("src")).alias(source), "size", "source_size", "target", "rate", "copies")


def mixing_params(sized: DataFrame, weights: list[float], share: float, most: int) -> DataFrame:
    """One row for each source: target, tilt, and a rounding shift for each size class.

    The documents of a class take whole copies by one shift, which brings their words next to what their rates ask for
    and what larger ones have left over; so a source misses its target by about one of its smallest documents.
    """
    same = ["src", "src_null"]
    hist = stored(sized.groupBy(*same, "size").agg(F.count("*").alias("n")), "hist")
    state = stored(tilted(hist, source_targets(sized, weights, share, most), most), "tilted")
    placed = sized.join(state, same).withColumn("rate", _rate(most)).withColumn("place", F.when(F.col("rate") < float(most), _place())).withColumn("level", _level())
    keys = [*same, "level"]
    fine = placed.groupBy(*keys, F.floor(F.col("place") / COARSE).alias("coarse"), "place").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.floor("rate")).alias("sure"), F.sum(F.col("size") * F.col("rate")).alias("asked"))
    fine = stored(fine, "places")
    # running sums over places in two steps, so that no window holds more rows than a class has coarse or fine places
    coarse = fine.where("place is not null").groupBy(*keys, "coarse").agg(F.sum("words").alias("words"))
    before = coarse.select(*keys, "coarse", (F.sum("words").over(Window.partitionBy(*keys).orderBy("coarse")) - F.col("words")).alias("ahead"))
    inside = F.sum("words").over(Window.partitionBy(*keys, "coarse").orderBy("place"))
    running = stored(fine.where("place is not null").join(before, [*keys, "coarse"]).select(*keys, "place", (F.col("ahead") + inside).alias("more")), "running")
    totals = stored(fine.groupBy(*keys).agg(F.sum("sure").alias("sure"), F.sum("asked").alias("asked")), "totals")

    found = state.select(*same, "target", F.lit(0.0).alias("taken"), F.lit(0.0).alias("asked_so_far"))
    for level in range(len(LEVELS), -1, -1):
        own = totals.where(F.col("level") == level).select(*same, "sure", "asked")
        found = found.join(own, same, "left").withColumn("asked_so_far", F.col("asked_so_far") + F.coalesce("asked", F.lit(0.0)))
        goal = (F.col("target") if level == 0 else F.col("asked_so_far")) - F.col("taken") - F.col("sure")
        here = running.where(F.col("level") == level).select(*same, "place", "more").join(found.select(*same, goal.alias("goal")), same)
        best = here.groupBy(*same).agg(F.min(F.struct(F.round(F.abs(F.col("more") - F.col("goal")), 6).alias("gap"), "place", "more")).alias("best"), F.round(F.abs(F.first("goal")), 6).alias("none"))
        best = best.select(*same, F.when(F.col("none") > F.col("best.gap"), F.col("best.place")).otherwise(-1).alias(f"shift{level}"), F.when(F.col("none") > F.col("best.gap"), F.col("best.more")).otherwise(0).alias("more"))
        found = found.join(best, same, "left").withColumn("taken", F.col("taken") + F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("sure", "asked", "more")
        found = stored(found, "shifts")
    shifts = [F.coalesce(f"shift{k}", F.lit(-1)) for k in range(len(LEVELS) + 1)]
    return stored(state.join(found.select(*same, F.array(*shifts).alias("shifts")), same), "mix")


def with_copies(sized: DataFrame, params: DataFrame, most: int) -> DataFrame:
    more = F.coalesce((F.col("place") <= F.col("shifts")[_level()]) & (F.col("rate") < float(most)), F.lit(False))
    found = sized.join(params, ["src", "src_null"]).withColumn("rate", _rate(most)).withColumn("place", _place())
    return found.withColumn("copies", F.least(F.floor("rate") + more.cast("long"), F.lit(most).cast("long")))


def mixed_documents(docs: DataFrame, weights: list[float], share: float, most: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, each as often as its copies say."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(*_sized(key, text, source), columns.alias("row"))
    sized = stored(rows.drop("row"), "sizes")
    if (turns := _turns(sized)) is not None:
        # numbers stand for rows as they were written, so texts are written with them
        rows = stored(rows, "rows")
        turns = _turns(rows.drop("row"))
        sized = rows.drop("row")
    rows, sized = _with_turns(rows, turns), _with_turns(sized, turns)
    params = mixing_params(sized, weights, share, most)
    copied = with_copies(rows, params, most).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
