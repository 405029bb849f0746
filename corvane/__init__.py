"""corvane: text retrieval, log analytics and relational operators as PySpark DataFrame functions."""
