"""sources of loamgrid."""
