"""Files of others: delimited text and JSON lines, with declared columns and what couldn't be read kept apart."""
