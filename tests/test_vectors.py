import numpy as np

from annalist.operators import vectors


def test_reexpansion_over_several_blocks(spark, monkeypatch):
    """Blocks of centroids and of observations meet, however many there are."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)).round(3)
    rows = [(i, i % 12, v.tolist()) for i, v in enumerate(x)]
    obs = spark.createDataFrame(rows, "seq long, arc long, embedding array<double>")
    members = obs.where("seq < 36")
    want = set()
    for arc in range(12):
        own = np.array([i for i in range(36) if i % 12 == arc])
        centre = x[own].mean(0)
        centre /= np.sqrt(centre @ centre)
        want |= {(arc, int(i)) for i in np.nonzero(x @ centre >= (x[own] @ centre).min() - 1e-12)[0]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, as on large tables
    try:
        got = vectors.reexpand(members, obs, "arc").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["arc"], r["seq"]) for r in got} == want and len(got) == len(want) > 36
