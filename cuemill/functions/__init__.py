"""Column functions: text, labels and numbers, all of built-in expressions."""
