"""streaming of slotforge."""
