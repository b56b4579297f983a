"""Column-to-column functions; everything stays in JVM expressions."""
