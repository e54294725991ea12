"""Reading and writing documents, runs and tables."""
