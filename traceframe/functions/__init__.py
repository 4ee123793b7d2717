"""Column functions: everything here is a Spark expression, evaluated in the JVM."""
