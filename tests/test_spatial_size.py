"""Spatial queries: pairs of points are neither moved nor looked up."""

import math
import random

from pyspark.sql import functions as F

from affinityloom.operators import spatial as P
from tests.test_compact_sets import shuffled

POINT = "structure int, site bigint, x double, y double, z double"


def crowd(count, width, seed=3):
    rng = random.Random(seed)
    return [(i % 2, i, *(rng.uniform(0, width) for _ in "xyz")) for i in range(count)]


def test_edges_are_not_moved_to_look_charges_up(spark):
    sites = spark.createDataFrame(crowd(1200, 4.0), POINT).withColumn("element", F.lit("O"))
    refined = sites.filter("site % 7 <> 0").select("structure", "site", (F.col("site") % 5 - 2.0).alias("refined_charge"), F.when(
        F.col("site") % 3 == 0, "metal_ion").otherwise("aromatic_centroid").alias("motif"))
    got = P.enriched_site_edges(sites, refined, "structure", "site")
    assert sorted(map(tuple, got.filter("site_a % 40 = 0").collect())) == sorted(map(tuple, P.enriched_edges(
        P.site_edges(sites, "structure", "site"), refined, "structure", "site").filter("site_a % 40 = 0").select(got.columns).collect()))
    before = shuffled(spark)
    edges = got.count()
    assert edges > 300_000 and shuffled(spark) - before < 4 * edges


def test_shells_by_loop(spark):
    """Sites see their atoms in one task; pairs are no rows."""
    points = crowd(300, 20.0) + [(0, 900, 0.0, 0.0, 0.0), (0, 901, 3.5, 0.0, 0.0), (1, 902, None, 1.0, 1.0), (None, 903, 1.0, 1.0, 1.0), (5, 904, 1.0, 1.0, 1.0)]
    atoms = spark.createDataFrame(points, POINT).withColumn("charge", F.when(F.col("site") % 11 != 0, F.col("site") % 4 - 1.5)).withColumn(
        "metal", F.when(F.col("site") % 9 != 0, F.col("site") % 3 == 0))
    got = P.shell_descriptors(atoms.filter("site % 2 = 0 OR site = 901"), atoms, "structure", "site", ["metal"], "charge")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(filter" not in plan
    found = {(r["site"], r["shell"]): r for r in got.collect()}
    sites = [p for p in points if p[1] % 2 == 0 or p[1] == 901]
    assert len(found) == 3 * len(sites)
    for s in sites:
        for name, low, high in (("shell_1", 0.0, 3.5), ("shell_2", 3.5, 6.0), ("shell_3", 6.0, 8.0)):
            near = [(math.dist(s[2:], a[2:]), a[1]) for a in points if a[0] is not None and a[0] == s[0] and None not in s + a]
            near = [(d, i) for d, i in near if d > 0 and low <= d <= high]
            charges = [(d, i % 4 - 1.5) for d, i in near if i % 11 != 0]
            r = found[s[1], name]
            assert r["neighbor_count"] == len(near) and r["metal_count"] == sum(i % 9 != 0 and i % 3 == 0 for _, i in near)
            assert (r["nearest"] is None) if not near else math.isclose(r["nearest"], min(near)[0])
            for column, value in (("charge_sum", sum(q for _, q in charges)), ("positive_sum", sum(q for _, q in charges if q > 0)),
                                  ("negative_sum", sum(q for _, q in charges if q < 0)), ("inverse_sum", sum(q / max(d, 0.1) for d, q in charges)),
                                  ("inverse_square_sum", sum(q / max(d * d, 0.1) for d, q in charges)), ("field_magnitude", abs(sum(q for _, q in charges)))):
                assert math.isclose(r[column], value, abs_tol=2e-6), (column, r, value)
