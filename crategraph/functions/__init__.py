"""Column functions: text, parsing, music and catalog values."""
