"""Text sources: target lists and reviewed staging files."""
