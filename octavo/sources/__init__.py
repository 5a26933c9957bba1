"""Where byte sequences come from and go to: ``(data_id, start, length, content)``."""
