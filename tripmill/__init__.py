"""Trip lakehouse on Spark: landing, conform, silver, quality, star schema and mart."""
