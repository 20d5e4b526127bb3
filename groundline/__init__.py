"""groundline: evidence grounding and review of extracted document data on Spark."""
