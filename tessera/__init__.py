"""tessera: clinical-report text analytics on PySpark."""
