"""Column functions: text, vectors, LLM output parsing, statistics."""
