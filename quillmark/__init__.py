"""quillmark: rank, search and audit the works that readers recommend, on Spark."""
