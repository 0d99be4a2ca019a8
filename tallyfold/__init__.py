"""Filing analytics on PySpark: facts, text chunks, peers, statements, streams."""
