"""operators of the document-collection engine."""
