"""The logical side: formulas, coefficient maps, penalties and model setups."""
