"""Column functions: text, formatting, jobs."""
