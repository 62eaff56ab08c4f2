"""slicewise: relational slices of data on Spark."""
