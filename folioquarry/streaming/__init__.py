"""streaming of the document-collection engine."""
