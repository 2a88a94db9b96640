"""Column functions: text, urls, hashes, markup, dates, vectors, scores."""
