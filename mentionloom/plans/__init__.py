"""mentionloom plans."""
