"""Thermal thresholds on hand-made histograms: buckets of half a degree from -10 on, -5 at bucket 10."""

from geotide.operators import satellite


def test_thermal_threshold():
    two = [0, 5, 20, 40, 30, 22, 15, 9, 4, 2, 3, 10, 40, 90, 60, 10]  # clouds at 3, least at 9, land at 13
    assert satellite.thermal_threshold(two, -10.0) == -10.0 + 9 * 0.5
    assert satellite.thermal_threshold(two, -17.0) == -17.0  # least at -12.5: too cold, no soft fall
    merged = [1, 2, 5, 10, 20, 40, 60, 66, 72, 80, 100, 200, 400, 200]  # 72, 66, 60 fall softly from 80 at 9: land at 12
    assert satellite.thermal_threshold(merged, -10.0) == -10.0 + 9 * 0.5
    flat = [0, 0, 0, 0, 0, 9, 8, 7, 2, 30, 90, 20]  # -6 / -7.5 = 0.8 is distinct, -11 / -12.5 = 0.88 is not
    assert satellite.thermal_threshold(flat, -10.0) == -6.0
    assert satellite.thermal_threshold(flat, -15.0) == -15.0


def test_thresholds_of_rasters(spark):
    counts = [0, 5, 20, 40, 30, 22, 15, 9, 4, 2, 3, 10, 40, 90, 60, 10]
    values = [-10.0 + k * 0.5 + 0.1 for k, n in enumerate(counts) for _ in range(n)]
    rows = [(0.0, 1.0, k, 0, v) for k, v in enumerate(values)]
    kind = "t1 double, t2 double, px long, py long, value double"
    difference = spark.createDataFrame(rows, kind)
    zenith = spark.createDataFrame([(a, b, x, y, 40.0) for a, b, x, y, _ in rows], kind)
    assert satellite.thermal_thresholds(difference, zenith, day=(0.0, 80.0), night=(93.0, 180.0), span=(-10.0, -2.0)) == {"day": -5.5, "night": -10.0}
