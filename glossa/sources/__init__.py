"""Where entries and files come from."""
