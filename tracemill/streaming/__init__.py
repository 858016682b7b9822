"""streaming of tracemill."""
