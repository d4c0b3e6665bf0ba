"""Reading responses, and the tables that are written."""
