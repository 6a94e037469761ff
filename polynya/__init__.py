"""Field-campaign analytics as Spark jobs: DataFrame in, DataFrame out."""
