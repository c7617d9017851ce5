"""Training-data operators (self-contained: nothing else in docloom imports this subpackage)."""
