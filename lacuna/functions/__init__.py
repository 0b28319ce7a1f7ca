"""Column functions: text rules, token folds and scores."""
