"""Column-level building blocks: text, lists, vectors, naming, formatting."""
