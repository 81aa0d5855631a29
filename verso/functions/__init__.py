"""Column functions: text, markup, model replies, voices."""
