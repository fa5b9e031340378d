import numpy as np
import pytest

from ledgerline.llm.whitening import bit_planes, scatter, whitened

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """x, its mean, covariance over distinct vectors, eigenvalues and vectors, by the definition."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    centred = once - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, values[::-1], axes[:, ::-1]


def held_against_plain(rows, got):
    vectors = [v for _, v in rows]
    x, n, s, values, axes = plain(vectors)
    k = min(16, x.shape[1])
    assert len(got) == k * len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(k):
        want = (x - s / n) @ axes[:, c] / np.sqrt(values[c])
        have = np.array([by_id[i, c + 1][0].whitened for i, _ in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
    for (i, _), row in zip(rows, x):
        r = by_id[i, 1][0]
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
    for c in range(k):
        assert got and abs(by_id[rows[0][0], c + 1][0].explained - values[c] / values.sum()) < 1e-9
    assert max(r.identity_error for r in got) < 1e-8


def test_the_given_table_against_the_definition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    held_against_plain(rows, whitened(table.repartition(5)).collect())


def test_scatter_is_exact_over_several_words_and_widths():
    rng = np.random.default_rng(5)
    u = np.column_stack([rng.integers(0, 2**b, 1000) for b in (0, 1, 9, 40, 13)] + [np.zeros(1000, dtype=np.int64)]).astype(np.uint64)
    bits = [int(c.max()).bit_length() for c in u.T]
    got = scatter(bit_planes(u, bits), bits)
    exact = u.astype(object)
    for i in range(6):
        for j in range(i, 6):
            assert got[i][j] == int((exact[:, i] * exact[:, j]).sum())


def test_odd_vectors_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    good = [(k, rng.normal(size=3).tolist()) for k in range(40)]
    rows = good + [(3, good[3][1]), (None, good[4][1]), (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("inf"), 2.0]), (95, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component int, vector int, x string").repartition(3)
    got = whitened(table).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {40} and {r.vec_id for r in got} == {None, *range(40)}
    as_floats = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in good]
    held_against_plain(as_floats, [r for k, r in enumerate(got) if r.vec_id is not None and not (r.vec_id == 3 and r in got[:k])])


def test_far_entries_are_exact_or_null(spark):
    rows = [(0, [1e300, 0.0]), (1, [-5.0, 1.0]), (2, [2.0, 3.0]), (3, [2.0**40, -1.0])]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got if r.vec_id == 0) and all(np.isfinite(r.whitened) for r in got if r.component == 1)


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_one_distinct_vector_has_no_variance(spark, rows):
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 2 * len(rows) and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)


def test_a_dimension_without_variance(spark):
    rows = [(k, [float(k), 1.0, float(k * k % 7)]) for k in range(20)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component == 3) for r in got) and {r.explained for r in got if r.component == 3} == {0.0} and max(r.identity_error for r in got) < 1e-9


def test_empty_table(spark):
    got = whitened(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
