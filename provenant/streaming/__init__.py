"""Quote checks over texts as they arrive."""
