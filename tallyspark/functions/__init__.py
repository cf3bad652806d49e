"""Column expressions: spaces, dates, money, names, masks. All run inside the JVM."""
