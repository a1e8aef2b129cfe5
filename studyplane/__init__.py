"""Academic-planning analytics on Spark: DataFrame in, DataFrame out."""
