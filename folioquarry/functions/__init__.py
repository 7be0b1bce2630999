"""functions of the document-collection engine."""
