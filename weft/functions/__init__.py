"""Column functions: text cleaning, splitting, parsing and label similarity."""
