"""Document structure, annotation projection and corpus preparation on PySpark."""
