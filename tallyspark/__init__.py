"""Document reconciliation analytics on PySpark."""
