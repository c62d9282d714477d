"""Document analytics on PySpark: a paged-document reader, and operators for text corpora."""
