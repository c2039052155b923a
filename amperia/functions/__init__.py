"""Column functions and generated dimensions."""
