"""Column expressions: vectors, kernels, scalar formulas, seeded uniforms."""
