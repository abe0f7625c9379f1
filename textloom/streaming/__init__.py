"""Row-local measures on streams."""
