"""Knowledge-graph memory and hybrid retrieval, expressed as Spark DataFrame plans."""
