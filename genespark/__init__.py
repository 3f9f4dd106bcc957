"""Population genomics tables on Spark: DataFrame in, DataFrame out."""
