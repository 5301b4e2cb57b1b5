"""Column functions: text, vectors, embedding and reranking."""
