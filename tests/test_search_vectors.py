import random

from lodeworks.operators import search


def test_nearest_of_each_query_over_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(300)] + [(300, [0.0] * 5), (301, None)]
    rows += [(400 + i, rows[i][1]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in search.nearest_to_each(df.filter("vec_id % 100 = 0"), df, 4, query_block=2, vector_block=50).orderBy("query_id", "score", "vec_id").collect():
        got.setdefault(r.query_id, {})[r.vec_id] = round(r.score, 6)
    assert set(got) == {0, 100, 200, 300, 400} and all(len(v) == 4 for v in got.values())
    for i in (0, 100, 200, 400):
        assert got[i] == {r.vec_id: round(r.score, 6) for r in search.nearest_vectors(df, list(df.filter(f"vec_id = {i}").first().embedding), 4).collect()}
    assert got[300] == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0}
    assert search.nearest_to_each(df.limit(0), df).count() == 0
