"""Training-data operators: one module per operator, plus shared kernels whose names start with an underscore.

Nothing outside this folder imports it.
"""
