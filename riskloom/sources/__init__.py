"""Reading client tables, writing results."""
