"""Web-page audit analytics and training-data operators on PySpark."""
