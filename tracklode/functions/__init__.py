"""Column functions: text, protocol, algebra and arrays."""
