"""Plans composed of operators: indexing, retrieval, the tool surface, the command line."""
