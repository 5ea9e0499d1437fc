"""Properties of the numpy kernels on generated rasters and rings."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from terrasheet.operators import components, geometry, kernels, tiles

MASKS = arrays(bool, st.tuples(st.integers(1, 10), st.integers(1, 10)))
POINTS = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=25).map(lambda p: np.array(p, float))
SOME = settings(max_examples=80, deadline=None)


def groups(mask, diagonal):
    ys, xs = np.nonzero(mask)
    return dict(zip(zip(ys.tolist(), xs.tolist(), strict=True), components.label_tile(ys, xs, diagonal).tolist(), strict=True))


@SOME
@given(MASKS)
def test_labels_partition_the_mask_and_eight_is_coarser(mask):
    four, eight = groups(mask, False), groups(mask, True)
    assert len(four) == len(eight) == mask.sum()
    coarse = {}
    assert all(coarse.setdefault(four[p], eight[p]) == eight[p] for p in four)
    for (y, x), label in four.items():
        assert four.get((y, x + 1), label) == label and four.get((y + 1, x), label) == label


@SOME
@given(MASKS)
def test_skeletons_keep_every_component(mask):
    thin = tiles.peeled(mask, 10**6)
    assert not (thin & ~mask).any()
    whole = groups(mask, True)
    kept = {whole[tuple(p)] for p in np.argwhere(thin).tolist()}
    large = {g for g in whole.values() if sum(v == g for v in whole.values()) > 4}
    assert large <= kept


@SOME
@given(MASKS)
def test_borders_run_along_the_mask(mask):
    for x, y in kernels.traced(mask).tolist():
        assert mask[int(y), int(x)]


@SOME
@given(MASKS, st.integers(0, 5))
def test_floods_stay_inside_and_keep_markers(mask, seed):
    rng = np.random.default_rng(seed)
    markers = (rng.random(mask.shape) < 0.1) * (1 + rng.integers(0, 3, mask.shape))
    labels = tiles.flood(rng.random(mask.shape), markers, mask, [])[2]
    assert not labels[~mask].any() and (labels[mask & (markers > 0)] == markers[mask & (markers > 0)]).all()
    assert set(np.unique(labels)) <= set(np.unique(markers)) | {0}


@SOME
@given(POINTS)
def test_hulls_hold_all_points(points):
    hull = geometry.hull_points(points)
    if len(hull) > 2:
        for a, b in zip(hull, np.roll(hull, -1, 0), strict=True):
            assert ((b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) >= 0).all()


@SOME
@given(POINTS, st.floats(0, 20))
def test_simplified_lines_keep_ends_and_stay_near(points, tolerance):
    kept = geometry.simplified(points, tolerance, False)
    assert (kept[0] == points[0]).all() and (kept[-1] == points[-1]).all()
    at = 0
    for a, b in zip(kept, kept[1:], strict=False):
        while not (points[at] == a).all():
            at += 1
        begin = at
        at += 1
        while not (points[at] == b).all():
            at += 1
        span = np.hypot(*(b - a))
        for p in points[begin + 1 : at]:
            off = abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / span if span else np.hypot(*(p - a))
            assert off <= tolerance + 1e-6 or (points[begin + 1 : at] == b).all(1).any()
