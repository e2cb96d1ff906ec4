"""flowlens: flow-table cleaning, detector scoring and shift analytics on Spark DataFrames."""
