"""mentionloom operators."""
