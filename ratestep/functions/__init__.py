"""Special functions, numerical kernels and the SQL surface."""
