"""Vector operators beside brute force."""

import numpy as np
import pytest

from fleetlens.llm import ann, queries, vectordup
from fleetlens.llm.crosspolytope import hadamard, nearest_axes, rotated

SMALLEST = "/root/testdata/sf0.001"
ODD = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1),
       (6, [None, 1.0], 1), (7, [1.0, 0.1], None), (8, [1.0, 0.1, 0.0], 1), (None, [1.0, 0.05], 1), (20, [1.0, 0.2], 2), (40, [], 1),
       (60, [float("inf"), 1.0], 1)]


@pytest.fixture
def odd_vectors(spark):
    rows = [(*r, 1, "q") for r in ODD]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, width int, cell string")


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(20, 50)).astype(np.float32)
    assert np.allclose(np.linalg.norm(rotated(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    assert hadamard(np.eye(4, dtype=np.float32)).tolist() == [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]
    near = nearest_axes(x, 3, 5)
    both = np.concatenate([rotated(x, 3), -rotated(x, 3)], axis=1)
    assert (near == np.argsort(-both, axis=1)[:, :5]).all()


def recall(spark, rows, got):
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for row in got:
        found.setdefault(row.query_id, []).append(row)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[at]
        scores[at] = -np.inf
        order = np.lexsort((ids, -scores))[:20]
        mine = sorted(found[ids[at]], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(mine, mine[1:]))
        place = {i: k for k, i in enumerate(ids)}
        assert all(abs(r.score - x[place[r.vec_id]] @ x[at]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[order].tolist()))
        total += 20
    return hits / total


def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    assert recall(spark, rows, queries.QUERIES["op3_nearest"](spark, "/root/testdata/sf0.01").collect()) >= 0.9


def test_nearest_ties_slices_and_odd_rows(spark, odd_vectors, monkeypatch):
    rows = [tuple(r) for r in ann.nearest(odd_vectors, odd_vectors.filter("vec_id % 20 = 0"), 20).collect()]
    assert [r[:3] for r in sorted(rows)] == [(20, 1, 7), (20, 2, 1), (20, 3, 2)]
    assert ann.nearest(odd_vectors.limit(0), odd_vectors.limit(0), 20).collect() == []
    monkeypatch.setattr(ann, "SLICE", 7)
    same = spark.createDataFrame([(i, [1.0, 2.0, -1.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(same, same.filter("vec_id = 20"), 5).collect()]
    assert sorted(got) == [(20, k + 1, k, 6.0) for k in range(5)]


def links_by_hand(rows, least=0.93):
    valid = [r[1] is not None and len(r[1]) and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and valid[i] and valid[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.array(r[1], np.float32), float) for r in (rows[i], rows[j]))
                near[i, j] = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= least
    reach = near | np.eye(n, dtype=bool)
    while True:
        more = (reach.astype(int) @ reach) > 0
        if (more == reach).all():
            break
        reach = more
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if reach[i, j] and rows[j][0] is not None]
        component = min(ids) if rows[i][0] is not None else None
        out.append((rows[i][0], int(near[i].sum()), component, component is None or rows[i][0] == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 5])
def test_near_vectors_in_groups(spark, monkeypatch, block):
    monkeypatch.setattr(vectordup, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = []
    for group in range(6):
        centre = rng.normal(size=32)
        for _ in range(25):
            rows.append((int(rng.permutation(1000)[0]) * 1000 + len(rows), [float(np.float32(v)) for v in centre + rng.normal(size=32) * 0.22], group % 2))
    rows += [(9_000_000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted((tuple(r) for r in vectordup.near_duplicate_vectors(df).collect()), key=str) == links_by_hand(rows)


def test_near_vectors_of_odd_rows(spark, odd_vectors):
    got = sorted((tuple(r) for r in vectordup.near_duplicate_vectors(odd_vectors).collect()), key=str)
    assert got == links_by_hand(ODD)
    assert vectordup.near_duplicate_vectors(odd_vectors.limit(0)).collect() == []
    rows = queries.QUERIES["op9_near_vectors"](spark, SMALLEST).collect()
    assert len(rows) == spark.read.parquet(f"{SMALLEST}/embeddings.parquet").count()


def test_vectors_of_any_length(spark):
    """Lengths beyond what squares or single precision hold; an id with two vectors; products that overflow, to one side and to both."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 16))
    lengths = [1e200, 1e-200, 1.0, 1e-310]
    rows = [(i, (x[i // 2] * lengths[(i + i // 2) % 4]).tolist(), 1) for i in range(120)]
    got = vectordup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert all(r.n_links >= 1 and r.component_id <= r.vec_id // 2 * 2 for r in got)

    base = [(1, [1e200, 1.0]), (2, [2e200, 0.0]), (3, [1e200, -1e200]), (4, [-1e200, 0.0]), (5, [1.0, 1.0]), (5, [0.5, 0.5]), (20, [1e200, 1e200])]
    df = spark.createDataFrame(base, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id = 20"), 20).orderBy("rank").collect()
    inf = float("inf")
    assert [(r.vec_id, r.score) for r in got] == [(1, inf), (2, inf), (5, 1e200), (3, -inf), (4, -inf)]
    got = ann.nearest(df, df.filter("vec_id = 20"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, inf), (2, inf)]
