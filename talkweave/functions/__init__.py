"""Column -> Column helpers; nothing here leaves the JVM."""
