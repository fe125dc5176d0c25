"""Session settings, scratch tables and iteration helpers."""
