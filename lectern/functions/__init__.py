"""Column builders: Column in, Column out."""
