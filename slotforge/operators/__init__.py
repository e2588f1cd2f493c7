"""operators of slotforge."""
