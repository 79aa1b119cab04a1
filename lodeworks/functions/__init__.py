"""Column expressions of the engine; all of them stay in the JVM."""
