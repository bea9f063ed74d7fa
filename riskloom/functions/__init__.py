"""riskloom subpackage."""
