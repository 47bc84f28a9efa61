"""Operators for geostationary satellite images, as column expressions over pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeops import to_datetime
from ..model import Grid, QueryError
from .rasters import PIXEL, replace_by_range, stack

# Fixed values, published by the satellites' operator: solar irradiance, and central wave number, alpha and beta for
# brightness temperatures, by satellite number and 12 channels.
ETSR = {
    8: [65.2296, 73.0127, 62.3715, 0, 0, 0, 0, 0, 0, 0, 0, 78.7599],
    9: [65.2065, 73.1869, 61.9923, 0, 0, 0, 0, 0, 0, 0, 0, 79.0113],
    10: [65.5148, 73.1807, 62.0208, 0, 0, 0, 0, 0, 0, 0, 0, 78.9416],
    11: [65.2656, 73.1692, 61.9416, 0, 0, 0, 0, 0, 0, 0, 0, 79.0035],
}
VC = {
    8: [0, 0, 0, 2567.330, 1598.103, 1362.081, 1149.069, 1034.343, 930.647, 839.660, 752.387, 0],
    9: [0, 0, 0, 2568.832, 1600.548, 1360.330, 1148.620, 1035.289, 931.700, 836.445, 751.792, 0],
    10: [0, 0, 0, 2547.771, 1595.621, 1360.337, 1148.130, 1034.715, 929.842, 838.659, 750.653, 0],
    11: [0, 0, 0, 2555.280, 1596.080, 1361.748, 1147.433, 1034.851, 931.122, 839.113, 748.585, 0],
}
ALPHA = {
    8: [0, 0, 0, 0.9956, 0.9962, 0.9991, 0.9996, 0.9999, 0.9983, 0.9988, 0.9981, 0],
    9: [0, 0, 0, 0.9954, 0.9963, 0.9991, 0.9996, 0.9999, 0.9983, 0.9988, 0.9981, 0],
    10: [0, 0, 0, 0.9915, 0.9960, 0.9991, 0.9996, 0.9999, 0.9983, 0.9988, 0.9982, 0],
    11: [0, 0, 0, 0.9916, 0.9959, 0.9990, 0.9996, 0.9998, 0.9983, 0.9988, 0.9981, 0],
}
BETA = {
    8: [0, 0, 0, 3.4100, 2.2180, 0.4780, 0.1790, 0.0600, 0.6250, 0.3970, 0.5780, 0],
    9: [0, 0, 0, 3.4380, 2.1850, 0.4700, 0.1790, 0.0560, 0.6400, 0.4080, 0.5610, 0],
    10: [0, 0, 0, 2.9002, 2.0337, 0.4340, 0.1714, 0.0527, 0.6084, 0.3882, 0.5390, 0],
    11: [0, 0, 0, 2.9438, 2.0780, 0.4929, 0.1731, 0.0597, 0.6256, 0.4002, 0.5635, 0],
}
C1, C2 = 1.19104273e-16, 0.0143877523
#: Degrees of scan angle in a unit of the view's coordinates, for the normal and the high-resolution channel.
VIEW_ANGLE = 65536 / (-13642337 * 3000.403165817)
VIEW_ANGLE_HRV = 65536 / (-40927014 * 1000.134348869)
EARTH_RADIUS, ASTRONOMICAL_UNIT = 6371.01, 149597890.0


@dataclass(frozen=True)
class Image:
    """What a raw image tells of itself: satellite 8 to 11, channel 1 to 12, calibration."""

    satellite: int
    channel: int
    offset: float
    slope: float

    def check(self, lo: int, hi: int) -> None:
        if self.satellite not in ETSR or not lo <= self.channel <= hi:
            raise QueryError(f"channels {lo} to {hi} of satellites 8 to 11")


def _with(df: DataFrame, value: Column) -> DataFrame:
    return df.filter("value is not null and not isnan(value)").withColumn("value", value)


def radiance(raw: DataFrame, image: Image) -> DataFrame:
    return _with(raw, F.lit(image.offset) + F.col("value") * image.slope)


def temperature(raw: DataFrame, image: Image) -> DataFrame:
    """Brightness temperature of raw counts 0 to 1023, by the inverse of Planck's law."""
    image.check(4, 11)
    k = image.channel - 1
    vc, alpha, beta = VC[image.satellite][k], ALPHA[image.satellite][k], BETA[image.satellite][k]
    seen = (F.lit(image.offset) + F.col("value") * image.slope) * 1e-5
    t = (C2 * 100 * vc / F.ln(C1 * 1e6 * vc**3 / seen + 1) - beta) / alpha
    return _with(raw, t)


@dataclass(frozen=True)
class Sun:
    sidereal: float
    ascension: float
    declination: float

    @staticmethod
    def at(t: float) -> Sun:
        """Position by the short series of the PSA algorithm, for a moment in epoch seconds."""
        hours = t % 86400 / 3600
        days = t / 86400 + 2440587.5 - 2451545.0
        omega = 2.1429 - 0.0010394594 * days
        anomaly = 6.2400600 + 0.0172019699 * days
        longitude = 4.8950630 + 0.017202791698 * days + 0.03341607 * math.sin(anomaly) + 0.00034894 * math.sin(2 * anomaly) - 0.0001134 - 0.0000203 * math.sin(omega)
        obliquity = 0.4090928 - 6.2140e-9 * days + 0.0000396 * math.cos(omega)
        ascension = math.atan2(math.cos(obliquity) * math.sin(longitude), math.cos(longitude)) % (2 * math.pi)
        return Sun(6.6974243242 + 0.0657098283 * days + hours, ascension, math.asin(math.sin(obliquity) * math.sin(longitude)))


def view_to_earth(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a scan angle in degrees; the satellite stands over 0 E."""
    a, b = F.radians(x), F.radians(y)
    q = F.cos(b) ** 2 + 1.006803 * F.sin(b) ** 2
    along = 42164 * F.cos(a) * F.cos(b)
    inside = along**2 - q * 1737121856
    sn = F.when(inside >= 0, (along - F.sqrt(F.greatest(inside, F.lit(0.0)))) / q)
    s1, s2, s3 = 42164 - sn * F.cos(a) * F.cos(b), sn * F.sin(a) * F.cos(b), -sn * F.sin(b)
    return F.degrees(F.atan(1.006804 * s3 / F.sqrt(s1**2 + s2**2))), F.degrees(F.atan(s2 / s1))


def solar_angles(lat: Column, lon: Column, sun: Sun) -> tuple[Column, Column]:
    """Azimuth and zenith in degrees, with parallax."""
    hour = F.radians(F.lit(sun.sidereal * 15) + lon) - sun.ascension
    phi = F.radians(lat)
    zenith = F.acos(F.cos(phi) * F.cos(hour) * math.cos(sun.declination) + math.sin(sun.declination) * F.sin(phi))
    azimuth = F.atan2(-F.sin(hour), math.tan(sun.declination) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    azimuth = F.when(azimuth < 0, azimuth + 2 * math.pi).otherwise(azimuth)
    return F.degrees(azimuth), F.degrees(zenith + EARTH_RADIUS / ASTRONOMICAL_UNIT * F.sin(zenith))


def _angles(grid: Grid, t: float, factor: float) -> tuple[Column, Column]:
    """At a pixel's corner, as the images give positions."""
    gx, gy = F.col("px") * F.lit(grid.sx) + grid.x1, F.col("py") * F.lit(grid.sy) + grid.y1
    return solar_angles(*view_to_earth(gx * -factor, gy * factor), Sun.at(t))


def solar_angle(raster: DataFrame, grid: Grid, t: float, which: str) -> DataFrame:
    if which not in ("azimuth", "zenith"):
        raise QueryError("azimuth or zenith")
    azimuth, zenith = _angles(grid, t, VIEW_ANGLE)
    return _with(raster, azimuth if which == "azimuth" else zenith)


def reflectance(rad: DataFrame, image: Image, grid: Grid, t: float, solar_correction: bool = True, hrv: bool = False) -> DataFrame:
    """Radiance over the sun's at its distance that day, and over the cosine of its zenith angle, at most 80 degrees."""
    channel = 12 if hrv else image.channel
    if channel not in (1, 2, 3, 12):
        raise QueryError("channels 1 to 3 and 12")
    day = to_datetime(t).timetuple().tm_yday
    distance = 1 - 0.0167 * math.cos(2 * math.pi * (day - 3) / 365)
    sun = ETSR[image.satellite][channel - 1] / math.pi
    value = F.col("value") * distance**2 / sun
    if solar_correction:
        _, zenith = _angles(grid, t, VIEW_ANGLE_HRV if channel == 12 else VIEW_ANGLE)
        value = value / F.cos(F.radians(F.least(zenith, F.lit(80.0))))
    return _with(rad, value)


def co2_correction(bt039: DataFrame, bt108: DataFrame, bt134: DataFrame) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = b**4 - (b - (b - c) / 4) ** 4
    return stack([bt039, bt108, bt134]).select("t1", "t2", *PIXEL, F.pow(a**4 + r, F.lit(0.25)).alias("value"))


# Fixed values, published with the method: the response of a low-resolution pixel to the 9 x 9 high-resolution ones around it.
RESPONSE = [
    [0.000683, 0.001347, 0.002680, 0.003929, 0.004373, 0.003929, 0.002680, 0.001347, 0.000683],
    [0.000885, 0.003331, 0.007027, 0.010179, 0.011055, 0.010179, 0.007027, 0.003331, 0.000885],
    [0.002129, 0.007592, 0.015244, 0.022005, 0.024218, 0.022005, 0.015244, 0.007592, 0.002129],
    [0.003886, 0.012650, 0.024532, 0.035293, 0.039513, 0.035293, 0.024532, 0.012650, 0.003886],
    [0.004785, 0.015318, 0.029237, 0.041485, 0.046473, 0.041485, 0.029237, 0.015318, 0.004785],
    [0.003886, 0.012650, 0.024532, 0.035293, 0.039513, 0.035293, 0.024532, 0.012650, 0.003886],
    [0.002129, 0.007592, 0.015244, 0.022005, 0.024218, 0.022005, 0.015244, 0.007592, 0.002129],
    [0.000885, 0.003331, 0.007027, 0.010179, 0.011055, 0.010179, 0.007027, 0.003331, 0.000885],
    [0.000683, 0.001347, 0.002680, 0.003929, 0.004373, 0.003929, 0.002680, 0.001347, 0.000683],
]


def _coarse(hrv: DataFrame, grid: Grid, spatial: bool) -> DataFrame:
    """HRV at a third of its resolution (px, py, h): means of 3 by 3, or by the response of the low-resolution sensor, where
    what would lie beyond the grid (of the HRV image) is taken from the opposite side of the pixel."""
    if not spatial:
        return hrv.groupBy(F.floor(F.col("px") / 3).alias("px"), F.floor(F.col("py") / 3).alias("py")).agg(F.avg("value").alias("h"), F.count(F.lit(1)).alias("_n")).filter("_n = 9").drop("_n")
    weights = F.array(*[F.array(*[F.lit(v) for v in row]) for row in RESPONSE])
    near = lambda c, n: F.sequence(F.greatest(F.ceil((F.col(c) - 5) / 3), F.lit(0).cast("long")), F.least(F.floor((F.col(c) + 3) / 3), F.lit(n // 3 - 1).cast("long")))
    sent = hrv.withColumn("x", F.explode(near("px", grid.width))).withColumn("y", F.explode(near("py", grid.height)))
    dx, dy = F.col("px") - F.col("x") * 3 - 1, F.col("py") - F.col("y") * 3 - 1
    weight = weights[(dy + 4).cast("int")][(dx + 4).cast("int")]
    for d, c, n in ((dx, F.col("x"), grid.width), (dy, F.col("y"), grid.height)):
        weight = weight * F.when((c * 3 + 1 - d).between(0, n - 1), 1.0).otherwise(2.0)
    # As in the original, the first row and column do not count.
    return sent.filter("px > 0 and py > 0").groupBy(F.col("x").alias("px"), F.col("y").alias("py")).agg(F.sum(F.col("value") * weight).alias("h"))


def pansharpen(low: DataFrame, hrv: DataFrame, grid: Grid, window: int = 5, cap: float | None = None, *, spatial: bool = False, distance: bool = True) -> DataFrame:
    """A channel at three times its resolution: HRV is averaged, a line log(channel) over log(HRV) is fitted in each window
    of low-resolution pixels, weighed by closeness if ``distance``, and applied to the HRV pixels below. A slope above 20
    counts as none. ``grid`` is the low-resolution one."""
    h = window // 2
    fine = lambda d: d.filter("value is not null and not isnan(value)")
    wide = Grid(grid.x1, grid.y1, grid.x2, grid.y2, grid.width * 3, grid.height * 3)
    pair = fine(low).select("t1", "t2", *PIXEL, F.ln(F.col("value") + 0.1).alias("v")).join(_coarse(fine(hrv), wide, spatial).select(*PIXEL, F.ln("h").alias("h")), PIXEL).filter("not isnan(v) and not isnan(h)")
    side = F.sequence(F.lit(-h), F.lit(h))
    sums = pair.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    weight = 1 / F.greatest(far, F.lit(0.5)) if distance and h else F.lit(1.0)
    sums = sums.withColumn("w", weight).groupBy((F.col("px") + F.col("dx")).alias("px"), (F.col("py") + F.col("dy")).alias("py")).agg(
        F.sum("w").alias("n"), F.sum(F.expr("w * h")).alias("x"), F.sum(F.expr("w * v")).alias("y"), F.sum(F.expr("w * h * v")).alias("xy"), F.sum(F.expr("w * h * h")).alias("xx")
    )
    flat = F.expr("n * xx - x * x")
    slope = F.when(F.abs(flat) > 1e-9 * F.expr("n * xx"), F.expr("n * xy - x * y") / flat)
    b = F.coalesce(F.when(F.abs(slope) <= 20, slope), F.lit(0.0))
    fitted = sums.withColumn("b", b).select(F.col("px").alias("_x"), F.col("py").alias("_y"), "b", F.expr("(y - b * x) / n").alias("a"))
    fitted = fitted.join(pair.select(F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")), ["_x", "_y"])
    out = fine(hrv).join(fitted, (F.floor(F.col("px") / 3) == F.col("_x")) & (F.floor(F.col("py") / 3) == F.col("_y")))
    value = F.exp("a") * F.pow("value", F.col("b")) - 0.1
    times = F.greatest("t1", "_t1").alias("t1"), F.least("t2", "_t2").alias("t2")
    return out.select(*times, *PIXEL, (F.least(value, F.lit(float(cap))) if cap is not None else value).alias("value"))


#: Search of the thermal threshold, in degrees and buckets.
LAND_PEAK_MIN, CLOUD_THRESHOLD_MIN, RISING, SOFT_FALLING = -5.0, -12.0, 3, 3
CLOUD_RATIO, MERGED_RATIO = 0.85, (0.8, 1.0)


def thermal_threshold(counts: list[int], lo: float, step: float = 0.5) -> float:
    """Lower border of the bucket between clouds (cold side) and land in a histogram whose first bucket starts at ``lo``.

    The minimum below the land peak counts if three buckets rise beyond it, it is not too cold and the cloud peak is
    distinct; else the cloud peak is taken as merged and the start of a soft fall of the land peak counts, or ``lo``."""
    border = lambda k: lo + k * step
    start = min(len(counts) - 1, max(0, math.floor((LAND_PEAK_MIN - lo) / step)))
    land = max(range(start, len(counts)), key=lambda k: (counts[k], -k)) if border(len(counts)) > LAND_PEAK_MIN else start
    least, rising = land, 0
    for k in range(land - 1, -1, -1):
        if counts[k] > counts[k + 1]:
            rising += 1
            if rising >= RISING:
                break
        else:
            rising = max(rising - 1, 0)
            least = k if counts[k] < counts[least] else least
    # As in the original, the coldest bucket above the minimum's count stands for the cloud peak.
    cloud = next((k for k in range(least) if counts[k] > counts[least]), least)
    merged, soft = 0, 0
    for k in range(land - 1, -1, -1):
        falls = counts[k + 1] > 0 and MERGED_RATIO[0] < counts[k] / counts[k + 1] <= MERGED_RATIO[1]
        soft = soft + 1 if falls else 0
        if soft >= SOFT_FALLING:
            merged = k + soft
            break
    low, peak = border(least), border(cloud)
    flat = cloud != least and (low / peak > CLOUD_RATIO if peak else low > 0)
    return border(merged) if rising < RISING or low < CLOUD_THRESHOLD_MIN or flat else low


def thermal_histogram(difference: DataFrame, zenith: DataFrame, *, day: tuple[float, float], night: tuple[float, float], span: tuple[float, float], step: float = 0.5) -> DataFrame:
    """part (day or night), bucket, n: buckets of ``step`` over ``span``, the end in the last, under each range of zenith
    angles (the end not included)."""
    buckets = max(1, math.ceil((span[1] - span[0]) / step))
    width = (span[1] - span[0]) / buckets
    z, d = F.col("b"), F.col("a")
    part = F.when((z >= day[0]) & (z < day[1]), "day").when((z >= night[0]) & (z < night[1]), "night")
    k = F.least(F.floor((d - span[0]) / width), F.lit(buckets - 1)).cast("long")
    both = stack([difference, zenith]).filter(d.between(*span)).select(part.alias("part"), k.alias("bucket")).filter("part is not null")
    return both.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thermal_thresholds(difference: DataFrame, zenith: DataFrame, *, day: tuple[float, float], night: tuple[float, float], span: tuple[float, float], step: float = 0.5) -> dict[str, float]:
    """Thresholds of a brightness temperature difference by day and night, from its histogram under each range of
    zenith angles. ``span`` is the range of the difference's unit; the ranges are the caller's."""
    rows = thermal_histogram(difference, zenith, day=day, night=night, span=span, step=step).collect()  # a few hundred buckets
    buckets = max(1, math.ceil((span[1] - span[0]) / step))
    width = (span[1] - span[0]) / buckets
    out = {}
    for name in ("day", "night"):
        counts = [0] * buckets
        for r in rows:
            if r["part"] == name:
                counts[r["bucket"]] = r["n"]
        out[name] = thermal_threshold(counts, span[0], width)
    return out


def threshold_raster(zenith: DataFrame, found: dict[str, float], day: tuple[float, float], night: tuple[float, float]) -> DataFrame:
    """The day's or night's threshold by zenith angle, -9999 between them, no data elsewhere."""
    return replace_by_range(zenith, [(*day, found["day"]), (day[1], night[0], -9999.0), (*night, found["night"])])
