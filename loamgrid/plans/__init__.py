"""plans of loamgrid."""
