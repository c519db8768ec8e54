"""From a host's clock to a device's: exchanges of least delay, a line for each piece of time, and markers mapped by it.

An exchange is (sent, received) on the host's clock and the device's time in between, all in seconds. The device's time belongs to the middle of the
exchange, with an error of half its round trip at most; so of each window only the exchange of the least round trip counts. A device's offset and drift are fitted
by least squares over the exchanges of a piece of several windows; pieces of fewer than two distinct moments take the fit of the piece before, or else
of the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.measures import interval_join


def best_exchanges(sync: DataFrame, by: list[str], sent: Column, received: Column, device: Column, window_s: float) -> DataFrame:
    """(by, host, device, round_trip) of the quickest exchange of each window; the earliest of equal ones. Negative round trips are no exchanges."""
    rows = sync.select(*by, ((sent + received) / 2).alias("host"), device.alias("device"), (received - sent).alias("round_trip")).where("round_trip >= 0 and device is not null")
    best = rows.groupBy(*by, F.floor(F.col("host") / window_s).alias("_window")).agg(F.min(F.struct("round_trip", "host", "device")).alias("b"))
    return best.select(*by, "b.host", "b.device", "b.round_trip")


def clock_map(exchanges: DataFrame, by: list[str], piece_s: float) -> DataFrame:
    """(by, piece, origin, offset, drift, exchanges, worst): device = host + offset + drift * (host - origin) in the piece that begins at origin; `worst` is
    the largest residual."""
    piece = F.floor(F.col("host") / piece_s)
    rows = exchanges.select(*by, piece.alias("piece"), (F.col("host") - piece * piece_s).alias("x"), (F.col("device") - F.col("host")).alias("y"))
    fits = rows.groupBy(*by, "piece").agg(
        F.count("*").alias("exchanges"), F.regr_slope("y", "x").alias("drift"), F.regr_intercept("y", "x").alias("offset"),
    )
    residual = F.abs(F.col("y") - F.col("offset") - F.col("drift") * F.col("x"))
    worst = rows.join(fits, [*by, "piece"]).groupBy(*by, "piece").agg(F.max(residual).alias("worst"))
    # as many rows as a device has pieces
    order = Window.partitionBy(*by).orderBy("piece")
    fit = F.when(F.col("drift").isNotNull(), F.struct("piece", "offset", "drift"))
    near = F.coalesce(F.last(fit, ignorenulls=True).over(order), F.first(fit, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = fits.join(worst, [*by, "piece"], "left").withColumn("_fit", near)
    return out.select(*by, "piece", (F.col("_fit.piece") * piece_s).alias("origin"), F.col("_fit.offset").alias("offset"), F.col("_fit.drift").alias("drift"), "exchanges", "worst")


def on_device(markers: DataFrame, clocks: DataFrame, by: list[str], columns: list[str], piece_s: float) -> DataFrame:
    """markers with each of `columns` on the device's clock, by the piece that it is in, or else the last one before; null where the device has none before."""
    out = markers.withColumn("_marker", F.monotonically_increasing_id())
    fits = clocks.select(*by, "piece", F.lead("piece").over(Window.partitionBy(*by).orderBy("piece")).alias("_next"), "origin", "offset", "drift")
    for c in columns:
        piece = F.floor(F.col(c) / piece_s)
        # an equality on the device, then one piece
        own = out.select("_marker", *by, c).join(fits, by).where((piece >= F.col("piece")) & (F.col("_next").isNull() | (piece < F.col("_next"))))
        mapped = own.select("_marker", (F.col(c) + F.col("offset") + F.col("drift") * (F.col(c) - F.col("origin"))).alias(f"device_{c}"))
        out = out.join(mapped, "_marker", "left")
    return out.drop("_marker")


def device_samples(samples: DataFrame, sessions: DataFrame, clocks: DataFrame, by: str, clock: str, start: str, end: str, piece_s: float, width: float) -> DataFrame:
    """Samples, on the device's clock, of sessions whose ends are on the host's."""
    mapped = on_device(sessions, clocks, [by], [start, end], piece_s).where(F.col(f"device_{start}").isNotNull() & F.col(f"device_{end}").isNotNull())
    return interval_join(samples, mapped, by, clock, f"device_{start}", f"device_{end}", width)
