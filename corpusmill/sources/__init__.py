"""Sources of corpusmill."""
