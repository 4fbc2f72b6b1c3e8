"""Match analytics on Spark: leakage-free features, score models, market odds, backtests."""
