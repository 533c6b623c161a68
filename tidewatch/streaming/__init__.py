"""Structured Streaming forms of the folds, on state that Spark keeps."""
