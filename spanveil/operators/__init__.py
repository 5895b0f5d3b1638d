"""DataFrame operators: detection, spans, scoring and training text."""
