"""mentionloom functions."""
