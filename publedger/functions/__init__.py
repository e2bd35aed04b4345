"""Column functions: numbers, dates, text, titles, web addresses, display formats."""
