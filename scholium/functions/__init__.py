"""Column functions: names, scores, labels, times and text."""
