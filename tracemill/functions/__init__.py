"""functions of tracemill."""
