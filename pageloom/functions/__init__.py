"""Column functions: text, HTML, URLs, dates, hashes."""
