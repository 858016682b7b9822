"""sources of tracemill."""
