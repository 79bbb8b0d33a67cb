"""Column expressions: cleaning, parsing and formatting, all evaluated in the JVM."""
