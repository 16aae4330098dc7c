"""quillspark: document-verification analytics on Spark."""
