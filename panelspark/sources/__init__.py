"""Reading and writing the tables and documents the operators work on."""
