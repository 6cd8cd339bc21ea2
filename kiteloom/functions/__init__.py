"""Functions of the library; see README.md for the map."""
