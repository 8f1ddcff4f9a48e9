"""Extension: provisional routing of a stream of scored windows."""
