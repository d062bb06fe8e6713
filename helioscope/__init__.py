"""helioscope: scientific analytics on Spark DataFrames."""
