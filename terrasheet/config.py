"""Fixed values of the map model: classes, palette, fills, features and the limits that steps use by default."""

from __future__ import annotations

# Fixed values, in the order of their index.
CLASSES = ["contours", "background", "building", "water"]
PALETTE = [(127, 127, 127), (255, 255, 255), (153, 255, 178), (191, 254, 178), (255, 191, 217), (255, 127, 204), (204, 255, 255)]
#: The class of each palette colour.
PALETTE_CLASS = [0, 1, 1, 1, 2, 2, 3]
FILLS = {"background": "#7f7f7f", "water": "#4ad2f5", "unknown": "#2cc243", "building": "#ff7fcc"}
SPECTRAL = ["median_h", "median_s", "median_v", "mad_h", "mad_s", "mad_v", "mean_h", "mean_s", "mean_v", "skew_h", "skew_s", "skew_v", "std_h", "std_s", "std_v"]
SHAPE = ["rectangularity", "solidity", "aspect_ratio", "elongation", "circularity", "convexity", "relative_area"]
FEATURES = SPECTRAL + SHAPE
SELECTED = [0, 1, 2, 6, 7, 8, 12, 14, 15, 19, 20, 21]
MIN_SEGMENT_PIXELS = 700
MIN_VALUE = 0.3
MIN_USABLE_PIXELS = 20
FOREGROUND_MOST = 253
EDT_CAP = 50
PATCHES, PATCH_SIDE = 15, 256
SENSITIVITY, SIMPLIFY, ENLARGE, SNAP = 0.15, 4.0, 2.85, 4.0
NEIGHBOUR_REACH = 20
AREA_BOUNDS = (1500, 300000)
IOU_BINS = [0.0, 0.5, 0.8, 1.0]
# The thresholds as floating-point steps of 0.05 give them: an IoU of exactly 0.7 isn't over the fifth.
IOU_THRESHOLDS = [0.5, 0.55, 0.6000000000000001, 0.6500000000000001, 0.7000000000000002, 0.7500000000000002, 0.8000000000000003, 0.8500000000000003, 0.9000000000000004, 0.9500000000000004]
TREES, TREE_DEPTH = 300, 8
