"""Functions that built-in ones cannot express."""
