"""Column expressions: spectral, weather, agronomy, geometry and quality."""
