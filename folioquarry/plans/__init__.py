"""plans of the document-collection engine."""
