"""functions of loamgrid."""
