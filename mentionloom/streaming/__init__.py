"""mentionloom streaming."""
