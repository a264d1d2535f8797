"""Plan helpers: durable cuts, global row numbers, and join choices by checked size."""
