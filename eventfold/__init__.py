"""eventfold: versioned-event analytics as Spark DataFrame jobs."""
