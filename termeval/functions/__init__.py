"""Column functions: text, prompts, similarity and list scores."""
