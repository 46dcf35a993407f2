"""Column expressions (X*): JVM-side, no Python in the row path."""
