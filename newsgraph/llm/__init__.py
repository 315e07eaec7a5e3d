"""Training-data operators: sharding, top-k search, mixing, toxicity, decontamination,
line and substring dedup, quality sampling, archive revisits, SimHash and MinHash near-dedup,
source divergence and hard negatives.

Nothing else in the library imports this subpackage.
"""
