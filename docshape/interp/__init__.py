"""Worker-side parts: document models and the walker over them."""
