"""Reading and writing: order tables, text logs, vectors, and the adapters for the sample tables."""
