"""What runs on Spark: lowering of plans, and profiles of the data."""
