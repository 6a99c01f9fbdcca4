"""panelforge: entity x time panel analytics on Spark DataFrames.

Bars from raw trades, rolling / exponential / cross-sectional features,
benchmark enrichment, forward labels, per-entity scaling, feature selection,
Spark ML classifiers per horizon and exact out-of-time metrics.
"""

__version__ = "0.1.0"
