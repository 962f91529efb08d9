"""Training-data operators. Nothing else in hopwright imports this subpackage."""
