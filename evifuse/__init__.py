"""Evidence-fusion analytics expressed as Spark DataFrame jobs."""
