"""Column helpers: grains, exact measures, user-defined measures and dimensions."""
