"""Tables that streams keep up."""
