"""End-to-end job E6 (and E4 inside it) on the smallest fixture."""

from pyspark.sql import functions as F

from vigila.plans import jobs as J
from vigila.sources.fixtures import incidents_view, calls_view
from conftest import SF_SMALL


def test_run_all(spark):
    out = J.run_all(spark, incidents_view(spark, SF_SMALL), calls_view(spark, SF_SMALL), salt="e2e-salt")
    assert set(out) == {"hotspots", "fir", "cdr", "graph_nodes", "graph_edges", "centrality", "predictions"}
    cent = out["centrality"]
    assert set(cent.columns) >= {"id", "degree", "pagerank", "eigenvector", "betweenness", "closeness"}
    assert cent.count() == out["graph_nodes"].count()
    assert abs(cent.agg(F.sum("pagerank")).first()[0] - 1.0) < 1e-9
    preds = out["predictions"].collect()
    assert 0 < len(preds) <= 100
    edges = {(r.src, r.dst) for r in out["graph_edges"].collect()}
    assert all((p.u, p.v) not in edges and (p.v, p.u) not in edges for p in preds)
    assert out["hotspots"].where(F.col("combined_prob_24h").isNull()).count() == 0
