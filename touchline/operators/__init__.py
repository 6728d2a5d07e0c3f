"""Relational forms of the detection, matching, window, geometry and clustering steps."""
