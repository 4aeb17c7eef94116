"""Column functions: names, key classes and log text."""
