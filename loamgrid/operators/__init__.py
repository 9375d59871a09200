"""operators of loamgrid."""
