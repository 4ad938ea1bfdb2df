"""Reading and writing of gridded series."""
