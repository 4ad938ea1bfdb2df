"""Plan reports, profiling and sessions."""
