"""Column functions: normalisation, tokens, patterns."""
