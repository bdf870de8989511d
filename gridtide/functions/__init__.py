"""Column functions: everything here builds expressions and starts no job."""
