import numpy as np
from helpers import rows

from attesta.operators import dense, ranking


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")


def test_search_in_many_tiles(spark, monkeypatch):
    """More rows than a tile and a batch hold, ties across them, rows of zeros and rows without a vector."""
    for name, n in (("BLOCK", 64), ("TILE", 32), ("ROWS", 50)):
        monkeypatch.setattr(dense, name, n)
    v = [*np.random.default_rng(5).integers(-2, 3, (700, 4)), None, [0, 0, 0, 0]]
    m = np.array([x for x in v if x is not None], float)
    ids = np.array([i for i, x in enumerate(v) if x is not None])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(n > 0, n, 1)
    asked = [i for i in range(len(v)) if i % 5 == 0 and v[i] is not None]
    want = []
    for q in asked:
        s = np.round(unit[ids == q] @ unit.T, 9)[0]
        want += [(q, int(ids[i]), r) for r, i in enumerate(np.lexsort((ids, -s))[:7])]
    df = table(spark, v).repartition(3)
    assert rows(dense.vector_search(df.where("vec_id % 5 = 0"), df, 7), "query_id", "vec_id", "rank") == sorted(want, key=repr)


def test_all_pairs(spark):
    v = [[1, 0], [0, 2], None, [0, 0], [3, 4]]
    df = table(spark, v)
    got = {(a, b): (s, d) for a, b, s, d in rows(dense.all_pairs(df.where("vec_id <> 1"), df))}
    assert len(got) == 20 and got[0, 4] == (0.6, 3.0) and got[4, 4] == (1.0, 25.0) and got[3, 0] == (0.0, 0.0)
    assert all((got[a, b] == (None, None)) == (2 in (a, b)) for a, b in got)
    assert rows(dense.all_pairs(df.where("vec_id > 9"), df)) == []


def test_best_holds_few_rows():
    rng, best, seen = np.random.default_rng(3), ranking.Best(5), []
    for i in range(200):
        q, ids, s = rng.integers(0, 40, 1000), np.arange(1000) + 1000 * i, np.round(rng.random(1000), 3)
        seen.append((q, ids, s))
        keep = s >= best.floors(40)[q]
        best.add(q[keep], ids[keep], s[keep])
        assert sum(len(x) for x, _, _ in best.held) < 20_000
    q, ids, s = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort((ids, -s, q))
    want = np.concatenate([order[q[order] == k][:5] for k in range(40)])
    assert all(np.array_equal(a, b[want]) for a, b in zip(best.rows(), (q, ids, s), strict=True))
