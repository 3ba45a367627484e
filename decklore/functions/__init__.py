"""Column functions: text and arithmetic of the retrieval rules."""
