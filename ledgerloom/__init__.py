"""Evidence-log, code-graph and retrieval analytics on Spark."""
