"""Column functions: URLs, markup, headers, scores."""
