"""Scalar kernels: a Python definition of each and, where Catalyst can express it, a Column."""
