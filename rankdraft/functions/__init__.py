"""Column functions: text, wikitext, checks, ranks and descriptions."""
