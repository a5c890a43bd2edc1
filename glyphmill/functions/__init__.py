"""Column functions: lexicons, text, tokens, language."""
