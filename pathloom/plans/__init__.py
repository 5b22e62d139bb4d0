"""Named queries over a directory of tables, and the SQL that must give the same rows."""
