"""Beyond batch questions: route events as a stream."""
