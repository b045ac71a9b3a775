"""Sources and sinks: JSON lines, run files, configuration and retrieval."""
