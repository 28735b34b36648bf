"""Nearest neighbours of repeated ids."""

import numpy as np

from tidepanel.llm import neighbours


def test_repeated_rows_and_ids_keep_their_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1, 90)]
    twin = [float(x) for x in rng.normal(size=6)]
    df = spark.createDataFrame(rows + [rows[19]] * 7 + [rows[4]] * 3 + [(40, twin)], "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, k=6, shard=32, block=2).collect()
    every = [*rows, (40, twin)]
    want = []
    for q, v in every:
        if q % 20 == 0:
            best = sorted((-float((np.array(w) * np.array(v)).sum()), i) for i, w in every if i != q)[:6]
            want += [(q, k, i, round(-s, 9)) for k, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
