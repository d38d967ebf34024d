"""Named queries composed from operators, plus the registry used by the entry module."""
