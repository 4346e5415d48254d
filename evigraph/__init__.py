"""Evidence-integration analytics on Spark DataFrames."""
