"""See the package README section of the same name."""
