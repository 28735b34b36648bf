"""Panel analytics on Spark: market-bar data preparation, factors, portfolios, risk and backtests."""
