"""Queries that go through command documents and streams."""

from __future__ import annotations

import json

from pointweave.plans.commands import Catalog, run_command
from pointweave.sources.tables import embedding_points
from queries.registry import EMB, query, knn_sql, pairs_sql, r
from queries.neighborhoods import SOR

STEPS = [
    {"Operation": "Subtraction", "FilterType": "ROR Filter", "Parameters": {"Radius": 0.1, "MinNeighborsInRadius": 6}},
    {"Operation": "Union", "FilterType": "Unknown", "Parameters": {}},
    {"Operation": "Intersection", "FilterType": "SOR Filter", "Parameters": {"KNeighbors": 50, "StdDevMulThresh": 0.5}},
]


@query("n9_composite_filter", f"""WITH {EMB}, {pairs_sql(0.1)}, {knn_sql(50)}, {SOR}, a AS (SELECT point_id, COUNT(*) < 6 AS o FROM pairs GROUP BY point_id)
SELECT point_id, o AND m > mu + CAST(0.5 AS DOUBLE) * sd AS is_outlier FROM a JOIN d USING (point_id), g""")
def n9(spark, sf):
    catalog = Catalog()
    number = catalog.add(embedding_points(spark, sf), "cloud")
    return run_command(catalog, json.dumps({"Command": "PerformCompositeFilter", "PointCloudID": number, "Pipeline": STEPS}))


@query("e6_command_radius_outliers", f"WITH {EMB}, {pairs_sql(0.12)} SELECT point_id, COUNT(*) AS neighbors, COUNT(*) < 5 AS is_outlier FROM pairs GROUP BY point_id")
def e6(spark, sf):
    catalog = Catalog()
    number = catalog.add(embedding_points(spark, sf), "cloud")
    return run_command(catalog, json.dumps({"Command": "PerformROR", "PointCloudID": number, "Radius": 0.12}))
