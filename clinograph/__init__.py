"""clinograph: evaluation of gridded, time-varying data on Spark DataFrames."""
