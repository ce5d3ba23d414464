"""Every operator of the library as a named query over the test tables, with the SQL that states the
same result."""
