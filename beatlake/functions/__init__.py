"""Column functions: scalars, keys, theory, tempo, salience and energy."""
