"""Reading source relations and writing result snapshots."""
