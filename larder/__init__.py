"""Stock analytics as Spark DataFrame transformations."""
