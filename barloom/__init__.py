"""barloom: market-bar analytics as Spark DataFrame, window and streaming jobs."""
