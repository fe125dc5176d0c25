"""corvigraph: knowledge-graph analytics over text and records, as Spark DataFrame plans."""
