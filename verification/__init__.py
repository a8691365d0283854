"""SQL twins of the registered queries, and the program that compares the two."""
