"""Tables from and to files and rows."""
