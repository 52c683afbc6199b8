"""The distributed transform against the one of a whole volume in one piece."""

import numpy as np
import pytest

from stackloom.operators import register, spectra


@pytest.mark.parametrize("upsample", [1, 10])
def test_pairs_of_several_shapes(spark, monkeypatch, upsample):
    monkeypatch.setattr(spectra, "TILE", 4)
    r = np.random.default_rng(7)
    pairs = {}
    for k, shape in {"a": (6, 9, 10), "bb": (5, 8, 4), "c": (1, 6, 6)}.items():
        a = r.normal(size=shape)
        pairs[k] = (a, np.roll(a, (1, -2, 1), (0, 1, 2)) + 0.1 * r.normal(size=shape))
    pairs["a"][1][2, 3, 4] = np.nan
    pairs["d"] = (np.ones((3, 4, 5)), np.ones((3, 4, 5)))
    rows = lambda i: spark.createDataFrame([(k, *map(int, at), float(v)) for k, p in pairs.items() for at, v in np.ndenumerate(p[i])], "scan_id string, plane long, y long, x long, v double")
    got = {r["scan_id"]: r for r in spectra.shift_of_volumes(rows(0), rows(1), upsample).collect()}
    assert got.keys() == pairs.keys()
    for k, (a, b) in pairs.items():
        shift, error = register.phase_shift(register.conditioned(a, 0.7), register.conditioned(b, 0.7), upsample)
        if k != "d":
            assert np.allclose([got[k]["dz"], got[k]["dy"], got[k]["dx"]], np.where(np.array(a.shape) > 1, shift, 0), atol=1e-9), k
        assert np.isclose(got[k]["error"], error, atol=1e-9, equal_nan=True), k
