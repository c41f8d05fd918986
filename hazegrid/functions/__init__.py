"""Column expressions. Nothing here reads data; everything stays inside code generation."""
