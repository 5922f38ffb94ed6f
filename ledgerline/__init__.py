"""Filing analytics on Spark: statements, features, scores, datasets and reports as DataFrame operators."""
