"""How plans are run: sessions, tables, and results kept in the shared folder."""
