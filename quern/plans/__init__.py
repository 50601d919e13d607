"""Plan documents: step tables, windows over steps, intervals, validation, question generation."""
