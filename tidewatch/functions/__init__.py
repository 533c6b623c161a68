"""Column functions.  Each returns a Column built from JVM-side expressions."""
