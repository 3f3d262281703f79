"""Index maintenance and statistics over streams."""
