"""Business record linkage on Spark: normalise, block, compare, decide, evaluate."""
