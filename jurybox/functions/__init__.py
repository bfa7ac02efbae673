"""Column expressions: text helpers, answer parsers, prompt rendering."""
