"""Column expressions shared by all operators (JVM-side, no Python workers)."""
