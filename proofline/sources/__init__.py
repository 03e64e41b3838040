"""Reading transcripts, dictionaries and tables, and writing tables and reports."""
