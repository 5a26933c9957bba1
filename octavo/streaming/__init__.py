"""Live logs: edits and selection changes as streams."""
