"""functions of slotforge."""
