"""DataFrame operators over canonical events."""
