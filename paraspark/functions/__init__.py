"""Column -> Column expressions (JVM-side, inside whole-stage codegen where Spark allows)."""
