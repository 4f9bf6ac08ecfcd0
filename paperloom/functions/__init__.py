"""Column expressions: one input row in, one value out, no shuffle."""
