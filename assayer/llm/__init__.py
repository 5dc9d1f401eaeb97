"""Training-data operators on Spark: extraction, filtering, deduplication, sharding, packing, formatting and scoring."""
