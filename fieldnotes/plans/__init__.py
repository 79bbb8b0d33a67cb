"""The registered queries and the SQL each one has to agree with."""
