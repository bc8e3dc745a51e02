"""panelmill: market-panel analytics expressed as Spark DataFrames."""
