"""Set-based operators over the library's tables."""
