"""Column expressions: hashes, tokens, markup, paths, canonical text and time."""
