"""quillgraph: a Spark-first engine for typed, evidence-backed property graphs."""
