"""Training-data operators (one subpackage; nothing else in the library imports it)."""
