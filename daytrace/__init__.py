"""Activity, log and text analytics as Spark DataFrame transforms."""
