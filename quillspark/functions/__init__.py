"""Column functions: text, URLs, HTML and JSON inside text."""
