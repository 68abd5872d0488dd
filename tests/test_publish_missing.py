"""Every day and place without a snapshot is found, however long ago."""

from __future__ import annotations

import datetime

from pricewell.plans import catalog
from pricewell.sources.adapters import with_views

SF = "/root/testdata/sf0.001"


def test_missing_snapshots_of_all_days(spark):
    cells = lambda sql: {tuple(r) for r in spark.sql(with_views(sql, True, SF)).collect()}
    days, places = cells("SELECT as_of FROM v_days"), cells("SELECT location_id FROM v_locations")
    grid = {d + k for d in days for k in places}
    missing = [tuple(r) for r in catalog.QUERIES["i37_publish_missing"](spark, SF).select("as_of", "location_id").collect()]
    assert len(missing) == len(set(missing))
    assert set(missing) == grid - cells("SELECT as_of, location_id FROM v_snapshots")
    assert min(d for d, _ in missing) < max(d for d, _ in grid) - datetime.timedelta(days=365)
