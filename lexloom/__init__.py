"""Amendment analytics over versioned, hierarchical documents, on Spark."""
