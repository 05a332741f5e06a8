"""Reports over the serving tables, and the jobs that write them."""
