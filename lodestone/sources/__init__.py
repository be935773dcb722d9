"""File sources and the filters that decide which files are read."""
