"""Seeded reserves play their parts at any size, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from tracklake.operators import alerts
from tracklake.sources import seeded

#: Individual and alert of the last cycle, and what the reason says where it is held back.
PLAYED = {
    (0, "buffer_ward"): None, (1, "centroid_shift"): None, (2, "absence"): None, (3, "new_station"): None, (4, "absence"): "coverage", (5, "new_station"): "installed this cycle",
    (6, "centroid_shift"): "minimum", (7, "buffer_ward"): "identity confidence", (8, "activity_collapse"): None,
}


def test_tables_do_not_depend_on_the_partitions(spark):
    sized = dict(reserves=3, stations=20, individuals=14, cycles=4, visits=3)
    one, many = (seeded.seeded_reserves(spark, **sized, partitions=p) for p in (1, 64))
    for name in one:
        assert sorted(map(str, one[name].collect())) == sorted(map(str, many[name].collect())), name
    other = seeded.seeded_reserves(spark, **sized, seed=43)["captures"]
    assert sorted(map(str, other.collect())) != sorted(map(str, one["captures"].collect()))


def test_foreign_keys_and_ranges(spark):
    t = seeded.seeded_reserves(spark, reserves=4, stations=17, individuals=12, cycles=3)
    c = t["captures"]
    assert c.count() == c.select("image_id").distinct().count() and t["stations"].count() == 68 and t["individuals"].count() == 48 and t["runs"].count() == 12
    for child, column, parent in (("captures", "station_id", "stations"), ("captures", "ind_id", "individuals"), ("captures", "run_id", "runs"), ("activity", "station_id", "stations"), ("runs", "reserve_id", "reserves"), ("stations", "reserve_id", "reserves")):
        assert t[child].join(t[parent].select(column), column, "left_anti").isEmpty(), (child, column)
    same = c.join(t["stations"].select("station_id", F.col("reserve_id").alias("r")), "station_id").join(t["runs"].select("run_id", F.col("reserve_id").alias("q"), "started_at"), "run_id")
    assert same.filter("reserve_id <> r or reserve_id <> q or captured_at < started_at or captured_at > started_at + INTERVAL 30 DAYS").isEmpty()
    assert c.filter("confidence < 0.4 or confidence > 1").isEmpty() and t["stations"].filter("lat not between 10 and 28 or lon not between 73 and 86").isEmpty()
    with pytest.raises(ValueError):
        seeded.seeded_reserves(spark, stations=5)


@pytest.mark.parametrize(("reserves", "stations", "individuals", "cycles"), [(1, 14, 10, 3), (6, 40, 30, 4)])
def test_every_part_raises_its_alert(spark, reserves, stations, individuals, cycles):
    t = seeded.seeded_reserves(spark, reserves, stations, individuals, cycles)
    found = alerts.survey_alerts(t["captures"], t["stations"], t["activity"], t["runs"]).filter(F.col("run_id") % cycles == cycles - 1)
    got = {(r["ind_id"], r["type"]): r for r in found.filter(F.col("ind_id") % individuals < seeded.N_CAST).collect()}
    for r in range(reserves):
        for (i, kind), reason in PLAYED.items():
            alert = got[r * individuals + i, kind]
            assert alert["suppressed"] == (reason is not None), (r, i, kind, alert)
            assert reason is None or reason in alert["suppress_reason"]
    assert not [k for k, v in got.items() if k[0] % individuals == 2 and not v["suppressed"] and k[1] != "absence"]
