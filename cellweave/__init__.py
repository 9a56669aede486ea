"""cellweave: expression analytics and corpus preparation written as Spark DataFrame functions."""
