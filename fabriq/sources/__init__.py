"""Where facts come from: snapshot folders, and a projection of plain tables onto the domain."""
