"""Page-inspection analytics on Spark: pages in, DataFrames of facts and verdicts out."""
