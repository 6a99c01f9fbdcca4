"""Comparison helpers for tests."""
import numpy as np


def assert_frames_close(a, b, keys=("ticker", "date"), rtol=1e-9, atol=1e-12):
    """Same rows and columns; floats equal within tolerance, NULL == NULL."""
    pa = a.toPandas().sort_values(list(keys)).reset_index(drop=True)
    pb = b.toPandas().sort_values(list(keys)).reset_index(drop=True)
    assert list(pa.columns) == list(pb.columns)
    assert len(pa) == len(pb)
    for c in pa.columns:
        x, y = pa[c], pb[c]
        if x.dtype.kind == "f" or y.dtype.kind == "f":
            x, y = x.to_numpy(float), y.to_numpy(float)
            both_nan = np.isnan(x) & np.isnan(y)
            close = np.abs(x - y) <= atol + rtol * np.maximum(np.abs(x), np.abs(y))
            bad = ~(both_nan | close)
            assert not bad.any(), f"{c}: {int(bad.sum())} rows differ, e.g. {x[bad][:3]} vs {y[bad][:3]}"
        else:
            assert (x.astype(str) == y.astype(str)).all(), f"{c} differs"
