"""Making, saving and loading cells."""
