"""Reading tables and writing result tables."""
