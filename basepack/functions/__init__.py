"""Scalar functions: kernels, Arrow UDFs and Catalyst expressions."""
