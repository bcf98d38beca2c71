"""Domain tables, from the driver tables or as given."""
