"""Column functions: URLs, HTML and text, n-grams and hashes, similarities."""
