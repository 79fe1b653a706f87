"""fabriq: a PySpark-native analytics engine for network configuration facts."""
