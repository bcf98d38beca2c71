"""Account classification and data-quality analytics on PySpark."""
