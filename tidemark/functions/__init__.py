"""Column expressions: text, URLs, HTML, dates, network addresses, fetch outcomes and messages."""
