"""Named queries over whole tables, and their SQL."""
