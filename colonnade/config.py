"""Numeric settings shared by the operators.  Every operator takes them as keyword defaults."""

# Result parity depends on them.
CONTAMINATION = 0.05
FOREST_SEED = 42
FENCE_MULTIPLIER = 1.5
SKEW_NORMAL = 0.5
HISTOGRAM_BINS = 40
PREVIEW_ROWS = 5
SIMILAR_TOP_N = 5
PIE_MAX_CATEGORIES = 8
BAR_MAX_NUMERIC_UNIQUES = 20
HISTOGRAM_MIN_UNIQUES = 6
BAR_TOP_N = 20
SEGMENT_TOP_N = 8

# Isolation forest defaults of Liu, Ting and Zhou (2008).
FOREST_TREES = 100
FOREST_SAMPLE = 256

# Up to this many rows, quantiles come from the built-in `percentile`, which holds every distinct
# value in one buffer; past it, from bracket refinement, which is faster there and holds little.
DIRECT_ROWS = 100_000
# The same per group.  A task may keep buffers of a hundred groups before it falls back to sorting.
GROUP_DIRECT_ROWS = 100_000

# Buckets per bracket and pass in the refinement.
REFINE_BUCKETS = 4096
