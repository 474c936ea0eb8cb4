import numpy as np
import pandas as pd

from tomewright.functions import images


def _stack(n, side, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    return np.stack([rng.normal(0, 30, (side, side)) + 100 + 60 * np.sin(x / (1 + i % 5) + y / (2 + i % 3)) for i in range(n)])


def test_stacks_equal_single_images():
    for side in (8, 16, 64):
        stack = _stack(7, side)
        assert images.phashes(stack) == [images.phash(x) for x in stack]
        singles, stacked = [images.cliff_scale(x) for x in stack], images.cliff_scales(stack)
        assert [s is None for s in singles] == [s is None for s in stacked]
        assert np.allclose([s or 0 for s in singles], [s or 0 for s in stacked])
        assert np.allclose(images.sharpnesses(stack, tile=12), [images.sharpness(x, tile=12) for x in stack])


def test_columns_of_mixed_sizes_and_nulls():
    column = pd.Series([_stack(1, 8)[0].ravel(), None, _stack(1, 16)[0].ravel(), np.zeros(64)])
    got = images.by_size(column, images.phashes)
    assert got[1] is None and got[0] == images.phash(_stack(1, 8)[0]) and got[2] == images.phash(_stack(1, 16)[0])
    smooth = np.outer(np.hanning(64), np.hanning(64)) * 200
    assert images.cliff_scales(smooth[None])[0] == images.cliff_scale(smooth) == 0.5
