"""Table, file and document sources and sinks."""
