"""Vector search for a set of queries, against brute force."""

import numpy as np

from stratagraph.operators import retrieval


def test_every_query_gets_its_nearest(spark):
    r = np.random.default_rng(5)
    m = np.round(r.normal(size=(90, 4)), 1)
    m[40:60] = m[20:40]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame([*rows, rows[3], (200, None), (220, [0.0] * 4)], "vec_id long, embedding array<float>")
    unit = (u := np.array([v for _, v in rows], "float32").astype(float)) / np.linalg.norm(u, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {(q, v) for q in range(0, 90, 20) for v in sorted(range(90), key=lambda v: (-score[q, v], v))[:7]}
    for size in (7, 4096):  # many blocks and one
        got = [(x.query_id, x.vec_id) for x in retrieval.dense_search_all(df, df.where("vec_id % 20 = 0"), 7, rows=size).collect()]
        assert len(got) == len(want) and set(got) == want
    assert retrieval.dense_search_all(df, df.where("vec_id < 0"), 7).count() == 0
