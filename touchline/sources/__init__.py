"""Input relations and output sinks."""
