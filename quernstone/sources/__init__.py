"""Reading and writing the tables that the operators work on."""
