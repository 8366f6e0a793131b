"""mentionloom sources."""
