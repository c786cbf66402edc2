"""Training-data operators: ten independent Spark jobs over documents, pages and conversations."""
