"""Order-dependent and reshaping operators on price panels."""
