"""streaming of loamgrid."""
