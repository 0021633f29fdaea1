"""Target-coverage analytics on Spark: interval algebra, read statistics, depth and reports."""
