"""What a change touches is written once and read from there, not made again for each use."""

from __future__ import annotations

from terrado.operators import group_upkeep


def test_touched_members_are_written_once(spark):
    members = spark.createDataFrame([(i, i - i % 2) for i in range(40)], "publicacion_id long, inmueble_id long")
    changed = spark.createDataFrame([(3, 9), (50, 60)], "publicacion_id long, candidata_id long")
    groups, listings = group_upkeep.touched_members(members, changed)
    assert sorted(r.inmueble_id for r in groups.collect()) == [2, 8]
    assert sorted(r.publicacion_id for r in listings.collect()) == [2, 3, 8, 9, 50, 60]
    for made in (groups, listings):
        assert made.inputFiles()
        assert all("/table-" in f for f in made.inputFiles())
