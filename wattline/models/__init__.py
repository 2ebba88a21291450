"""Model operators: Spark ML fits and expression-based scoring."""
