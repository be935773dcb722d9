"""Column expressions over queries, texts and vectors."""
