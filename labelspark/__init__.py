"""labelspark: label-compliance analytics as Spark DataFrame jobs."""
