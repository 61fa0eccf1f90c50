"""Column functions: text cleaning and normalising, and spatial look-ups on nested pages."""
