"""hitgauge: offline evaluation of semantic caches, written as Spark DataFrame jobs."""
