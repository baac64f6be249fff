"""Plans of corpusmill."""
