"""Column functions: text measures, redaction, chunks, retrieval scores."""
