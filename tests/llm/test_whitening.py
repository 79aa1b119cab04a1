import math

import numpy as np
import pytest

from lodeworks.llm import whitening


def brute(rows, k=4):
    """(vec_id, vector) -> what each row and component must be, by a whole covariance matrix."""
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in whole]
    fit = sorted(set(x))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float) - np.array(s) / n
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    return whole, n, dev, (np.array(x, float) - np.array(s) / n) @ q / np.sqrt(e), e / np.trace(a.T @ a / n)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long").repartition(3)


@pytest.mark.parametrize(("d", "spread"), [(3, 1.0), (24, 1.0), (60, 0.8), (60, 1.0)])
def test_against_the_whole_covariance(spark, d, spread):
    """Flat and falling spectra, below and above the first block, with repeated rows and rows to be passed over."""
    rng = np.random.default_rng(d)
    v = rng.standard_normal((400, d)) * spread ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    rows = [(i, [float(c) for c in x], 1, 2) for i, x in enumerate(v)] + [(1000 + i, [float(c) for c in v[7]], None, None) for i in range(150)]
    odd = [(2000, None, 1, 1), (2001, [None] + [0.0] * (d - 1), 1, 1), (2002, [math.nan] * d, 1, 1), (2003, [math.inf] + [0.0] * (d - 1), 1, 1), (None, [0.5] * d, 1, 1)]
    df = frame(spark, rows + odd)
    whole, n, dev, want, explained = brute([r[:2] for r in rows + odd])
    got = sorted(whitening.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component))
    k = min(4, d)
    assert len(got) == k * len(whole) and {r.n for r in got} == {n}
    assert [r.vec_id for r in got[::k]] == [i for i, _ in whole] and [r.deviation for r in got[::k]] == dev
    y = np.array([r.whitened for r in got]).reshape(-1, k)
    turn = np.sign((y * want).sum(0))
    assert np.abs(y - want * turn).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    found = whitening.fit(df)
    assert (found.residuals <= 1e-12 * found.eigenvalues[0]).all() and found.passes < 40


def test_a_falling_spectrum_needs_no_wide_block(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 200)) * np.where(np.arange(200) < 6, 30.0 * 0.5 ** np.arange(200), 0.02)
    found = whitening.fit(frame(spark, [(i, [float(c) for c in x], 1, 1) for i, x in enumerate(v)]))
    assert found.block == 16 and found.passes > 2


def test_nothing_varies_or_nothing_is_there(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25], 1, 1), (2, [0.5, 0.25], 1, 1)])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)
    }
    line = whitening.whiten(frame(spark, [(i, [i / 8, 1.0, -2.0], 1, 1) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-12
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None, 1, 1)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [], 1, 1)])).count() == 0


def test_lengths_differ_and_entries_are_huge(spark):
    rows = [(i, [float(i), 1.0 + i % 3], 1, 1) for i in range(20)] + [(50, [1.0], 1, 1), (51, [1.0, 2.0, 3.0], 1, 1)]
    with pytest.warns(UserWarning, match="2 entries"):
        assert {r.vec_id for r in whitening.whiten(frame(spark, rows)).collect()} == set(range(20))
    huge = whitening.whiten(frame(spark, [(1, [3e38, -3e38], 1, 1), (2, [1.0, 300000.0], 1, 1), (3, [0.0, 0.0], 1, 1)])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id == 1)
    x = np.array([[0, 1], [2**40, -1], [-(2**63), 2**63 - 1], [-5, 3]], np.int64)
    assert (whitening._unpack(whitening._pack(x), 2) == x).all()
