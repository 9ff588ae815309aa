"""Extraction of symbols, imports and edges from source files: one parser a language, run in mapInArrow."""
