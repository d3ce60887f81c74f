"""meterloom: quarter-hour load-profile analytics on Spark DataFrames."""
