"""lumenfield: DataFrame-first analytics over semantic fields, hyperbolic layouts and Semitic text."""

__version__ = "0.1.0"
