"""Column expressions: identifiers, packed words, geometry, sky pixels, sampling, gridding."""
