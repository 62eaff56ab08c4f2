"""Where tables, their keys and saved slices come from and go to."""
