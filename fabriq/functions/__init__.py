"""Column functions of the domain: addresses, prefixes, paths, metrics."""
