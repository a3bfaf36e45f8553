"""Named queries: each module offers QUERIES (name -> callable) and SQL (name -> reference statement)."""
