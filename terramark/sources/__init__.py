"""Where grids, factors and tables come from and go to."""
