"""refweave: code-relationship analytics and corpus preparation on PySpark."""
