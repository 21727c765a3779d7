"""Queries that look at windows and images use all targets and all images."""

import pytest

from parcelspark.operators import readiness as Y
from parcelspark.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.range(240).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    return path


def test_every_17th_parcel_is_a_target(spark, folder, monkeypatch):
    seen = []
    real = Y.outside_target
    monkeypatch.setattr(Y, "outside_target", lambda w, t: seen.append({r.id for r in t.select("id").collect()}) or real(w, t))
    rows = CATALOG["windows_outside_target"].run(spark, folder).collect()
    assert seen == [set(range(0, 240, 17))]
    assert {r.id for r in rows}.isdisjoint(range(0, 240, 17))


def test_parcels_of_all_lattice_rows_have_an_image(spark, folder):
    rows = {r.id: r.image_index for r in CATALOG["first_matching_image"].run(spark, folder).collect()}
    # the upper rows too, and images are shared by projects
    assert {i % 60 for i in rows} >= set(range(45)) and rows[0] == rows[60] == 0 and max(rows.values()) < 60
