"""tickforge: intraday market-data analytics on Spark."""
