"""Column functions: time, text, prices, cost, strict JSON."""
