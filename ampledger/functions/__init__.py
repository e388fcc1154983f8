"""Column functions: time, calendar, load."""
