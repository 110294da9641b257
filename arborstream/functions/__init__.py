"""Column expressions: JVM-side scalar functions, vector functions and deterministic uniforms."""
