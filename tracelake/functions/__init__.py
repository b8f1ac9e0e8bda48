"""Column functions: JVM-side expressions, no Python rows."""
