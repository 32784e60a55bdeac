"""Column expressions. Everything here stays on the JVM; there are no Python UDFs."""
