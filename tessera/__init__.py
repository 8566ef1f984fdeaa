"""Evidence-backed knowledge-graph analytics on Spark."""
