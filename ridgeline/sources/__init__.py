"""Reading, normalising and storing prices."""
