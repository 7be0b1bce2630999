"""sources of the document-collection engine."""
