"""A content-safety analytics engine on PySpark."""
