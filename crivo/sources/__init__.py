"""Reading documents, pages and rules."""
