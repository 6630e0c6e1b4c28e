"""Column builders: text, geography, time. Everything here stays in the JVM."""
