"""Reading captured files and writing reports."""
