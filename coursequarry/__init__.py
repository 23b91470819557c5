"""Learning-resource search, reply scoring and activity analytics as Spark DataFrame jobs."""
