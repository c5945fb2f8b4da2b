"""Knowledge-graph and retrieval analytics expressed as Spark plans."""
