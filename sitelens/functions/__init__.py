"""Scalar functions: column expressions, and Arrow functions where no built-in exists."""
