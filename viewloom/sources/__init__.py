"""Where graphs and collections are read from and written to."""
