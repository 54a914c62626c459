"""The criterion language: lexer, syntax tree, validation, and its two compilations."""
